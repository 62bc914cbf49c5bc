"""Approximate nearest neighbours: low-dimensional 2-stable projections, a kd-tree over them, and a chi-square stop.

A Gaussian projection of a difference at distance d has a squared length of d^2 times a chi-square variable of as
many degrees as there are projections. A query's neighbours are visited by growing projected distance and verified
on the original vectors, until the next projected distance r satisfies r^2 > q d_k^2: with q the chi-square
quantile, a nearer neighbour than the k-th found so far would have shown up with that probability. The kd-tree's
leaves are the partitions: each query first searches its own leaf, which bounds d_k, and then those leaves only
whose boxes reach into its ball. Inside a leaf a kd-tree of its own gives small buckets, which a query visits by
growing distance of their boxes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm.common import read, stored

K = 5
EVERY = 50
PROJECTIONS = 10
CERTAINTY = 0.98
LEAF = 4096  # rows of a leaf, about
BUCKET = 32  # rows of a bucket inside a leaf, about
SAMPLE = 16_384  # rows that the tree's first cuts are fitted on, at most
A_LEAF = 16  # sampled rows that a leaf's border is drawn by
DEEPER = 6  # further cuts inside each of these leaves, fitted on rows of their own, at most
QUERY_BLOCK = 4096  # queries that meet a leaf in one task


def chi_square_quantile(p: float, degrees: int) -> float:
    """By bisection of the distribution function of an even number of degrees: 1 - exp(-x/2) sum (x/2)^i / i!."""
    assert degrees % 2 == 0, "an even number of projections"
    lo, hi = 0.0, 40.0 * degrees
    for _ in range(200):
        x = (lo + hi) / 4
        below = 1 - math.exp(-x) * sum(x**i / math.factorial(i) for i in range(degrees // 2))
        lo, hi = ((lo + hi) / 2, hi) if below < p else (lo, (lo + hi) / 2)
    return hi


def projection(dimensions: int, m: int) -> np.ndarray:
    return np.random.default_rng(1_000_003 * m + dimensions).standard_normal((dimensions, m))


class Tree(NamedTuple):
    """Cuts of a complete binary tree, node i's children at 2i and 2i + 1; leaves' boxes."""

    depth: int
    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), "i8")
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.cut[node])
        return node - (1 << self.depth)

    def reach(self, point: np.ndarray) -> np.ndarray:
        """Squared distance from a point to every leaf's box."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0.0)
        return (gap * gap).sum(1)


def grow(points: np.ndarray, depth: int) -> Tree:
    """Cut at medians of the widest axis, ``depth`` times."""
    m = points.shape[1]
    axis, cut = np.zeros(1 << depth, "i8"), np.zeros(1 << depth)
    low, high = np.full((2 << depth, m), -np.inf), np.full((2 << depth, m), np.inf)
    inside = {1: points}
    for node in range(1, 1 << depth):
        some = inside.pop(node)
        a = int(np.argmax(np.ptp(some, axis=0))) if len(some) else 0
        c = float(np.median(some[:, a])) if len(some) else 0.0
        axis[node], cut[node] = a, c
        right = some[:, a] >= c
        inside[2 * node], inside[2 * node + 1] = some[~right], some[right]
        for child in (2 * node, 2 * node + 1):
            low[child], high[child] = low[node], high[node]
        high[2 * node, a] = low[2 * node + 1, a] = c
    return Tree(depth, axis, cut, low[1 << depth :], high[1 << depth :])


def grafted(top: Tree, below: dict[int, Tree], deeper: int) -> Tree:
    """The tree whose leaves are cut ``deeper`` times more, by the tree of each leaf; those without one stay whole."""
    depth, m = top.depth + deeper, top.low.shape[1]
    axis, cut = np.zeros(1 << depth, "i8"), np.full(1 << depth, np.inf)  # nothing is at or beyond an infinite cut
    axis[: len(top.axis)], cut[: len(top.cut)] = top.axis, top.cut
    for leaf, tree in below.items():
        for level in range(deeper):
            first = ((1 << top.depth) + leaf) << level
            axis[first : first + (1 << level)], cut[first : first + (1 << level)] = tree.axis[1 << level : 2 << level], tree.cut[1 << level : 2 << level]
    low, high = np.full((2 << depth, m), -np.inf), np.full((2 << depth, m), np.inf)
    for node in range(1, 1 << depth):
        for child in (2 * node, 2 * node + 1):
            low[child], high[child] = low[node], high[node]
        high[2 * node, axis[node]] = low[2 * node + 1, axis[node]] = cut[node]
    return Tree(depth, axis, cut, low[1 << depth :], high[1 << depth :])


def cleaned(vectors: DataFrame, m: int) -> DataFrame:
    """(vec_id, dims, vec, unit projection, digest) of the vectors that take part, equal rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist()):
                if i is None or not v or None in v:
                    continue
                x = np.array(v, "f8")
                norm = math.sqrt(float((x * x).sum()))
                if not np.isfinite(norm) or norm == 0:
                    if not np.isfinite(x).all() or not x.any():
                        continue
                    x = x / np.abs(x).max()  # finite, but its square isn't
                    norm = math.sqrt(float((x * x).sum()))
                raw = x.astype("<f8").tobytes()
                rows.append((i, len(x), raw, (x / norm @ projection_of(len(x))).astype("<f8").tobytes(), xxhash.xxh3_128_hexdigest(raw)))
            cols = list(zip(*rows)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["vec_id", "dims", "vec", "proj", "digest"])

    known: dict[int, np.ndarray] = {}

    def projection_of(n: int) -> np.ndarray:
        if n not in known:
            known[n] = projection(n, m)
        return known[n]

    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return some.mapInArrow(run, "vec_id bigint, dims int, vec binary, proj binary, digest string").dropDuplicates(["vec_id", "digest"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, m: int = PROJECTIONS, certainty: float = CERTAINTY) -> DataFrame:
    """The ``k`` nearest rows of ``vectors(vec_id, embedding, ...)`` by cosine for each row of ``queries``.

    Returns query_id, rank (from 1), vec_id, score. A query's own vec_id is no candidate. Vectors that are null, empty,
    zero or hold null or non-finite components take no part, nor do rows without vec_id; only vectors of equal length are
    compared; a row given twice counts once; ties go to the smaller vec_id; fewer candidates than ``k`` are all returned;
    other columns are ignored; empty tables give no rows. Of equal vectors the k + 1 smallest ids are searched, which is
    exact, as no other can be among the k nearest. At any size at most SAMPLE rows and a row a leaf reach the driver.
    """
    quantile = chi_square_quantile(certainty, m)
    every = stored(cleaned(vectors, m))
    asked = stored(cleaned(queries, m))
    copy = F.row_number().over(Window.partitionBy("digest").orderBy("vec_id"))
    rows = stored(every.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy", "digest"))
    trees: dict[int, Tree] = {}

    def placed(df: DataFrame) -> DataFrame:
        """Rows with their leaf."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dims = np.array(b.column("dims").to_pylist(), "i8")
                points = np.frombuffer(b"".join(b.column("proj").to_pylist()), "<f8").reshape(len(dims), -1)
                cells = np.zeros(len(dims), "i4")
                for d in np.unique(dims):
                    if d in trees:
                        cells[dims == d] = trees[d].leaf(points[dims == d])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells)], names=[*b.schema.names, "cell"])

        return df.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", cell int")

    for r in rows.groupBy("dims").agg(F.count("*").alias("n")).collect():  # a row a length
        some = rows.where(F.col("dims") == r.dims)
        sample = some.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(SAMPLE).select("proj").collect()
        points = np.stack([np.frombuffer(x.proj, "<f8") for x in sample])
        leaves = -(-r.n // LEAF)
        top = grow(points, max(0, math.ceil(math.log2(min(leaves, max(1, len(points) // A_LEAF))))))
        trees[r.dims] = top
        deeper = min(DEEPER, math.ceil(math.log2(leaves / (1 << top.depth)))) if leaves > 1 << top.depth else 0
        if deeper:  # rows of its own for each leaf: so many a cut, whatever the table's size
            chance = min(1.0, (2 * A_LEAF << top.depth + deeper) / r.n)
            even = F.pmod(F.xxhash64(F.lit(1), "vec_id", "vec"), F.lit(1 << 40)) / float(1 << 40)

            def cuts(key: tuple, have: pd.DataFrame) -> pd.DataFrame:
                tree = grow(np.stack([np.frombuffer(x, "<f8") for x in have.proj]), deeper)
                return pd.DataFrame({"cell": [key[0]], "axis": [tree.axis.tobytes()], "cut": [tree.cut.tobytes()]})

            grown = placed(some.where(even < chance).select("dims", "proj")).groupBy("cell").applyInPandas(cuts, "cell int, axis binary, cut binary").collect()  # a row a leaf of the first cuts
            below = {x.cell: Tree(deeper, np.frombuffer(x.axis, "i8"), np.frombuffer(x.cut, "f8"), top.low, top.high) for x in grown}
            trees[r.dims] = grafted(top, below, deeper)

    base = stored(placed(rows))
    home = stored(placed(asked.withColumnRenamed("vec_id", "query_id")))
    # a row a leaf, of which there are at most (SAMPLE / A_LEAF) << DEEPER a length
    leaves = stored(base.groupBy("dims", "cell").agg(F.count("*").alias("n")).select("dims", "cell", F.when(F.col("n") > 2 * LEAF, F.ceil(F.col("n") / LEAF)).otherwise(F.lit(1)).cast("int").alias("pieces")))

    def search(key: tuple, asks: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        """Visit a leaf's buckets by growing projected distance until the chi-square test holds."""
        out: list[tuple] = []
        if len(asks) and len(have):
            low = np.frombuffer(b"".join(have.proj), "<f8").reshape(len(have), -1)
            inner = grow(low, max(0, math.ceil(math.log2(len(have) / BUCKET)))) if len(have) > BUCKET else None
            bucket = inner.leaf(low) if inner else np.zeros(len(have), "i8")
            order = np.argsort(bucket, kind="stable")
            starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            ends = np.append(starts[1:], len(order))
            low = low[order]
            box_low, box_high = np.minimum.reduceat(low, starts), np.maximum.reduceat(low, starts)
            ids = have.vec_id.to_numpy()[order]
            x = np.frombuffer(b"".join(have.vec), "<f8").reshape(len(have), -1)[order]
            norms = np.sqrt((x * x).sum(1))
            for q, vec, proj, digest, far in zip(asks.query_id, asks.vec, asks.proj, asks.digest, asks.bound):
                v, point = np.frombuffer(vec, "<f8"), np.frombuffer(proj, "<f8")
                n = math.sqrt(float((v * v).sum()))
                gap = np.maximum(np.maximum(box_low - point, point - box_high), 0.0)
                gap = (gap * gap).sum(1)
                turn = np.argsort(gap, kind="stable")
                best_id, best = np.zeros(0, "i8"), np.zeros(0)
                at, step = 0, 2
                while at < len(turn) and gap[turn[at]] <= quantile * far:
                    some = np.concatenate([np.arange(starts[i], ends[i]) for i in turn[at : at + step]])
                    at, step = at + step, min(2 * step, 64)
                    away = low[some] - point
                    some = some[((away * away).sum(1) <= quantile * far) & (ids[some] != q)]
                    s = (x[some] * v).sum(1) / (norms[some] * n)
                    best_id, best = np.concatenate([best_id, ids[some]]), np.concatenate([best, s])
                    top = np.lexsort((best_id, -best))[:k]
                    best_id, best = best_id[top], best[top]
                    if len(best) == k:
                        far = min(far, 2 - 2 * best[-1])
                out += [(q, digest, i, s) for i, s in zip(best_id.tolist(), best.tolist())]
        return pd.DataFrame(out, columns=["query_id", "digest", "vec_id", "score"])

    schema = "query_id bigint, digest string, vec_id bigint, score double"
    key = ["dims", "cell", "piece", "block"]

    def visit(asks: DataFrame) -> DataFrame:
        """Leaves meet the queries that reach them; a leaf is copied once for every QUERY_BLOCK of these."""
        met = asks.groupBy("dims", "cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks")).join(leaves, ["dims", "cell"])
        plan = F.broadcast(stored(met))  # a row a leaf
        left = asks.join(plan, ["dims", "cell"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
        left = left.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces", "blocks")
        right = base.join(plan, ["dims", "cell"]).withColumn("piece", F.pmod(F.xxhash64("vec_id", "vec"), F.col("pieces")).cast("int"))
        right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("pieces", "blocks")
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, schema)

    best = Window.partitionBy("query_id", "digest").orderBy(F.col("score").desc(), "vec_id")
    first = stored(visit(home.withColumn("bound", F.lit(4.0))).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"))
    reached = first.groupBy("query_id", "digest").agg(F.when(F.count("*") >= k, 2 - 2 * F.min("score")).otherwise(F.lit(4.0)).alias("bound"))
    known = home.join(reached, ["query_id", "digest"], "left").withColumn("bound", F.coalesce("bound", F.lit(4.0)))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = []
            for d, p, c, bound in zip(*(b.column(n).to_pylist() for n in ("dims", "proj", "cell", "bound"))):
                near = trees[d].reach(np.frombuffer(p, "<f8")) <= quantile * bound if d in trees else np.zeros(0, bool)
                cells.append([int(i) for i in np.flatnonzero(near) if i != c])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*b.schema.names, "cells"])

    further = known.mapInArrow(others, ", ".join(f"{c} {t}" for c, t in known.dtypes) + ", cells array<int>")
    further = stored(further.withColumn("cell", F.explode("cells")).drop("cells"))
    found = first.unionByName(visit(further))
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % EVERY == 0))
