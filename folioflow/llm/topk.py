"""Exact top-k inner-product search with block bounds.

Candidates of one vector are one entry with its k + 1 smallest ids, which are all that can be named.
Entries go to cells around centroids of a bounded sample; a cell is cut into document-range blocks of
entries that lie together.  Blocks keep, for every term (dimension), their largest and smallest
weight, so for a query the sum over terms of its weight times the fitting extreme bounds every
score in the block.  A query is scored against its own cell first, which gives it a k-th score to
beat; only the pairs of query and cell whose bound reaches that score are shipped.  In a cell,
blocks are visited by falling bound and scored through their forward index (the block's rows)
until the bound falls below the k-th score; an equal bound is still visited, as ties go to smaller ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Entries of a block; entries of a cell, pairs of a chunk and cells of a group of bounds, on average.
BLOCK, CELL, CHUNK, GROUP = 32, 8_192, 4_096, 1_024
#: Vectors that the centroids are fitted on, and centroids, at most; more cells come from dealing by hash.
SAMPLE, CENTROIDS = 16_384, 512
FOUND = "qkey long, vec_id long, score decimal(38,0)"
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v: floor(256 * x) of each component x as double, kept as a whole-valued double.  Vectors that
    are null, or hold a component that is null or not finite (times 256), are left out; so are rows
    without an id, which no result can name."""
    v = F.transform(vector, lambda x: x.cast("double") * 256)
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    # a double of 2^53 or more is whole already
    whole = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & sound).select(F.col(key).cast("long").alias("vec_id"), F.transform(v, whole).alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(flat.flatten(), np.float64).reshape(n, -1)


def exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """float64 where every product sum is exact in it, else Python integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return np.float64 if most < 2**52 else object


def as_integers(x: np.ndarray, kind: type) -> np.ndarray:
    return x if kind is np.float64 else np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def tight_order(c: np.ndarray, leaf: int = BLOCK) -> np.ndarray:
    """An order of rows in which neighbours lie together: halves along the widest direction, again and again."""
    out, todo = [], [np.arange(len(c))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        with np.errstate(all="ignore"):
            some = c[rows] - c[rows].mean(0)
            direction = some.std(0)
            for _ in range(4):  # power iterations towards the leading direction
                direction = some.T @ (some @ direction)
                size = np.linalg.norm(direction)
                if not np.isfinite(size) or size == 0:
                    direction = np.zeros(some.shape[1])
                    break
                direction = direction / size
            by = rows[np.argsort(some @ direction, kind="stable")]
        half = -(-len(by) // (2 * leaf)) * leaf
        todo += [by[half:], by[:half]]
    return np.concatenate(out) if out else np.arange(0)


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For each query and range, a number that no score of the range exceeds (rounded upwards)."""
    with np.errstate(all="ignore"):
        ceiling = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        ceiling = ceiling + 1e-9 * (np.abs(q) @ np.maximum(np.abs(high), np.abs(low)).T)
    return np.nan_to_num(ceiling, nan=np.inf, posinf=np.inf, neginf=-np.inf)


def top_of_cell(floor: np.ndarray, own: list, q: np.ndarray, ids: list[list[int]], c: np.ndarray, k: int, block: int = BLOCK) -> tuple[list, int]:
    """((query row, vec_id, score) of the k best entries of a cell for each query, blocks scored).

    ``ids`` lists the ids of each entry.  ``own`` is each query's own id: one row of that id in an entry of
    the query's very vector is the query itself.  Scores below ``floor`` are of no use to a query."""
    order = tight_order(c, block)
    c, ids = c[order], [ids[i] for i in order]
    kind = exact_type(q, c)
    cut = range(0, len(ids), block)
    high, low = (np.array([f(c[i : i + block], axis=0) for i in cut]) for f in (np.max, np.min))
    ceiling = bounds(q, high, low)
    whole_q, whole_c = as_integers(q, kind), as_integers(c, kind)
    visits = np.argsort(-ceiling, axis=1, kind="stable")
    best: list[list] = [[] for _ in own]
    bar = np.array(floor, np.float64)
    active, scored, start, width = np.arange(len(own)), 0, 0, 1
    while len(active) and start < len(cut):
        # each query's next blocks, more of them each round, as long as their bounds reach its bar
        turns = visits[active, start : start + width]
        going = ceiling[active[:, None], turns] >= bar[active][:, None]
        rows, columns = np.nonzero(going)
        who, where = active[rows], turns[rows, columns]
        scored += len(who)
        order_ = np.argsort(where, kind="stable")
        who, where = who[order_], where[order_]
        edges = np.r_[0, np.flatnonzero(np.diff(where)) + 1, len(where)]
        for low_, high_ in zip(edges[:-1], edges[1:]):
            if low_ == high_:
                continue
            some, first = who[low_:high_], int(where[low_]) * block
            scores = whole_q[some] @ whole_c[first : first + block].T
            hits = scores >= bar[some][:, None]
            for at in np.flatnonzero(hits.any(1)):
                i, fresh = some[at], []
                for j in np.flatnonzero(hits[at]):
                    names = list(ids[first + j])
                    if own[i] in names and np.array_equal(q[i], c[first + j]):
                        names.remove(own[i])
                    fresh += [(scores[at, j], n) for n in names[:k]]
                best[i] = sorted(best[i] + fresh, key=lambda x: (-x[0], x[1]))[:k]
                if len(best[i]) >= k:
                    bar[i] = max(bar[i], np.nextafter(float(best[i][-1][0]), -np.inf) if kind is object else float(best[i][-1][0]))
        active = active[going[:, -1]]
        start, width = start + width, 2 * width
    return [(i, n, int(s)) for i, found in enumerate(best) for s, n in found], scored


def centroids(sample: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """A few rounds of k-means from evenly spread rows of the sample."""
    out = sample[np.linspace(0, len(sample) - 1, n).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(sample, out)
        for i in range(len(out)):
            if (near == i).any():
                out[i] = sample[near == i].mean(0)
    return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.argmax(x @ centres.T - 0.5 * (centres * centres).sum(1), axis=1)


def _assigned(entries: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``entries`` with dim and centre, the nearest centroid of their length (0 where none was sampled)."""
    shared = entries.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            sizes, place = np.array([len(v) for v in batch.column("v")]), np.zeros(batch.num_rows, np.int32)
            for d, c in shared.value.items():
                rows = np.flatnonzero(sizes == d)
                if d and len(rows):
                    place[rows] = nearest(matrix(batch.column("v").take(pa.array(rows)), len(rows)), c)
            yield batch.append_column("dim", pa.array(sizes, pa.int32())).append_column("centre", pa.array(place, pa.int32()))

    return entries.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema.fields) + ", dim int, centre int")


def _deal(parts: Column, *of: str) -> Column:
    return F.pmod(F.xxhash64(*of), parts).cast("int")


def search(df: DataFrame, queries: DataFrame, k: int = 5, cell: int = CELL, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``df`` for each row of ``queries`` (both vec_id, v).

    ``queries`` are rows of ``df``; every row of ``df`` but the query's own is a candidate, so rows of one id
    meet, and repeated rows count as often as they are there.  Ties go to smaller ids.  Queries with
    fewer candidates get all of them; empty tables give no rows.  Vectors of different lengths do not
    meet, and those of length 0 take no part.  Ranking is exact at any size of components; a score
    beyond 64 bits is given as the nearest 64-bit number.
    """
    scratch = Scratch(df.sparkSession)
    key = F.xxhash64("v", F.lit(1))
    rows = scratch.write(df.where(F.size("v") > 0).select("vec_id", "v", key.alias("vkey")), "vectors")
    # the k + 1 smallest ids of each vector: all that its ties can name, one of them maybe the query's own
    named = rows.groupBy("vkey", "v", "vec_id").agg(F.least(F.count("*"), F.lit(k + 1)).cast("int").alias("n"))
    order = Window.partitionBy("vkey", "v").orderBy("vec_id")
    named = named.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    listed = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "n"))), lambda x: F.array_repeat(x["vec_id"], x["n"])))
    entries = scratch.write(named.groupBy("vkey", "v").agg(F.slice(listed, 1, k + 1).alias("ids")), "entries")
    total = entries.count()
    cells = max(1, -(-total // cell))
    fitted: dict[int, np.ndarray] = {}
    some = entries.orderBy(F.pmod("vkey", F.lit(1 << 40)), "vkey").select("v").limit(SAMPLE).collect()
    for d in {len(r.v) for r in some}:
        sample = np.array([r.v for r in some if len(r.v) == d])
        fitted[d] = centroids(sample, min(CENTROIDS, cells, len(sample)))
    placed = scratch.write(_assigned(entries, fitted), "placed")
    sizes = placed.groupBy("dim", "centre").agg(F.ceil(F.count("*") / cell).cast("int").alias("salts"))
    salted = placed.join(sizes, ["dim", "centre"]).withColumn("salt", _deal(F.col("salts"), "vkey"))
    salted = scratch.write(salted.withColumn("cell", F.xxhash64("dim", "centre", "salt")).select("vkey", "v", "ids", "dim", "cell"), "cells")

    asked = queries.where(F.size("v") > 0).groupBy("vec_id", "v").agg(F.count("*").alias("times"))
    asked = asked.select(F.xxhash64("vec_id", "v").alias("qkey"), "vec_id", "v", key.alias("vkey"), "times")
    home = asked.join(salted.select("vkey", F.col("v").alias("same"), "dim", "cell"), "vkey").where(F.col("v") == F.col("same")).drop("same", "vkey")
    home = scratch.write(home, "queries")

    def score(pairs: DataFrame) -> DataFrame:
        """FOUND of pairs (qkey, vec_id, v, cell, floor), each query's k best of the cell."""
        crowd = pairs.groupBy("cell").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
        crowd = scratch.write(crowd, "crowds")
        left = pairs.join(crowd, "cell").select("qkey", "vec_id", "v", "floor", "cell", _deal(F.col("chunks"), "qkey").alias("chunk"))
        other = crowd.select(F.col("cell").alias("to"), F.col("chunks").alias("copies"))
        entry = salted.select(F.col("cell").alias("cell"), F.col("ids").alias("ids"), F.col("v").alias("v"))
        right = entry.join(other, F.col("cell") == F.col("to")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("to", "copies")

        def cogroup(a: pa.Table, b: pa.Table) -> pa.Table:
            found: list = []
            if a.num_rows and b.num_rows:
                q, c = matrix(a["v"], a.num_rows), matrix(b["v"], b.num_rows)
                found, _ = top_of_cell(a["floor"].to_numpy(), a["vec_id"].to_pylist(), q, b["ids"].to_pylist(), c, k, block)
            names = a["qkey"].to_pylist()
            at, ids, scores = zip(*found) if found else ((), (), ())
            # far beyond any 64-bit score, order among giants is kept as far as the type goes
            wide = [max(-(10**38) + 1, min(10**38 - 1, s)) for s in scores]
            return pa.table({"qkey": pa.array([names[i] for i in at], pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(wide, pa.decimal128(38, 0))})

        return left.groupBy("cell", "chunk").cogroup(right.groupBy("cell", "chunk")).applyInArrow(cogroup, FOUND)

    best = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    first = scratch.write(score(home.withColumn("floor", F.lit(float("-inf")))), "own-cells")
    ranked = first.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("qkey", F.col("score").cast("double").alias("bar"))
    # the bar as a double may lie above the exact score
    waiting = home.join(ranked, "qkey", "left").withColumn("floor", F.coalesce(F.col("bar") - 1e-9 * F.abs("bar"), F.lit(float("-inf"))))
    waiting = scratch.write(waiting.select("qkey", "vec_id", "v", "times", "dim", F.col("cell").alias("own_cell"), "floor"), "waiting")

    # term maxima and minima of each cell, from all of its entries; a cell is of bounded size
    def widest(t: pa.Table) -> pa.Table:
        v = matrix(t["v"], t.num_rows)
        one = {"dim": pa.array([v.shape[1]], pa.int32()), "cell": t["cell"].slice(0, 1).combine_chunks()}
        return pa.table(one | {n: pa.array([f(v, axis=0)], pa.list_(pa.float64())) for n, f in (("high", np.max), ("low", np.min))})

    extremes = salted.select("cell", "v").groupBy("cell").applyInArrow(widest, "dim int, cell long, high array<double>, low array<double>")
    extremes = scratch.write(extremes, "bounds")
    groups, chunks = max(1, -(-extremes.count() // GROUP)), max(1, -(-waiting.count() // chunk))
    left = waiting.withColumn("chunk", _deal(F.lit(chunks), "qkey")).withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = extremes.withColumn("set", _deal(F.lit(groups), "cell")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def reaching(a: pa.Table, b: pa.Table) -> pa.Table:
        keep_q: list = []
        keep_c: list = []
        if a.num_rows and b.num_rows:
            ceiling = bounds(matrix(a["v"], a.num_rows), matrix(b["high"], b.num_rows), matrix(b["low"], b.num_rows))
            good = ceiling >= a["floor"].to_numpy()[:, None]
            good &= a["own_cell"].to_numpy()[:, None] != b["cell"].to_numpy()[None, :]
            keep_q, keep_c = np.nonzero(good)
        return pa.table({"qkey": a["qkey"].take(pa.array(keep_q, pa.int64())), "cell": b["cell"].take(pa.array(keep_c, pa.int64()))})

    keys = ("dim", "chunk", "set")
    pairs = scratch.write(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(reaching, "qkey long, cell long"), "pairs")
    second = scratch.write(score(pairs.join(waiting.select("qkey", "vec_id", "v", "floor"), "qkey")), "other-cells")
    every = first.unionByName(second).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    score64 = F.greatest(F.lit(LOW).cast("decimal(38,0)"), F.least(F.lit(HIGH).cast("decimal(38,0)"), F.col("score"))).cast("long")
    out = every.join(waiting.select("qkey", F.col("vec_id").alias("query_id"), "times"), "qkey")
    out = out.select("query_id", "rank", "vec_id", score64.alias("score"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")).drop("time")
    scratch.discard(first, second, waiting)
    return out
