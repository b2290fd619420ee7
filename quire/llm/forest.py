"""Approximate nearest neighbours by a hash-prefix forest.

Each of TREES trees gives a vector a string of LENGTH bits, signs of projections on the tree's own random directions
(of the vector less the sample's mean). A tree is its rows in the order of their strings; rows that share a prefix lie
side by side. A query descends each tree to its own string, and then ascends all trees in step, to shorter and shorter
prefixes, until the rows that share the prefix number `want` over all trees; those are its candidates.

Prefix counts come from a histogram of the strings, TREES * 2**LENGTH numbers at most, so each query's depth is known
before rows move. `want` is at least TREES * (k + 1), so that a query has k other rows among its candidates. Beyond that it
is fitted on at most SAMPLE queries: these are compared with all rows, and the least `want` is taken at which the candidates
hold FOUND of their true neighbours; so the search is as wide as the data need it. Rows then go, once for each tree, to the
task of their prefix at the base depth, the depth that all but a hundredth of the queries reach; there they are sorted by
string and each query takes the range of its own prefix. A group is dealt out as a grid of at most about BLOCK rows by
QUERIES queries, so one dense region does not make one task. Queries that must ascend beyond the base depth, at last to the
root, and those that repeated ids leave with fewer than k rows, are compared with all rows in such grids. Each task gives
its K nearest; the best of those are kept.

Equal vectors are one point of the forest that carries its K + 1 smallest ids, which is as many as a query can need.

Defined results: vectors that take no part (see vectors.read), and those that differ in width from most (of equally many the
smaller width counts), are neither queries nor candidates; an empty table gives no row. Ties go to the smaller id. Vectors
that share an id are one: the nearest of them counts, among queries as among candidates, and never its own id. Extra columns
are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import textkit as tk
from quire.llm.common import Workspace, arrow_pass
from quire.llm.vectors import common_width, component_bytes, matrix, read

TREES = 24
LENGTH = 14
SAMPLE = 128
FOUND = 0.96
BLOCK = 4096
QUERIES = 1024


def _directions(width: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(31)).standard_normal((width, TREES * LENGTH))


def strings(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Each row's string in each tree, as a number of LENGTH bits."""
    bits = (x @ directions > 0).reshape(len(x), TREES, LENGTH)
    return bits @ (1 << np.arange(LENGTH - 1, -1, -1))


def _nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int, once: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the k ids nearest to q other than `own`, ties to the smaller id. once: no id repeats."""
    d = np.sqrt(((x - q) ** 2).sum(axis=1))
    d = np.where(ids == own, np.inf, d)
    if not once:
        order = np.lexsort((ids, d))
        some = np.sort(order[np.sort(np.unique(ids[order], return_index=True)[1])][:k])
    elif len(d) > 4 * k:
        bar = np.partition(d, k - 1)[k - 1]
        some = np.flatnonzero(d <= bar)
    else:
        some = np.arange(len(d))
    some = some[np.lexsort((ids[some], d[some]))][:k]
    some = some[np.isfinite(d[some])]
    return d[some], ids[some]


_HIT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _hits(found) -> pa.RecordBatch:
    q = np.concatenate([np.full(len(d), i) for i, d, _ in found]) if found else []
    return tk.batch(_HIT, query_id=np.asarray(q, np.int64), vec_id=np.concatenate([n for *_, n in found]) if found else [], score=np.concatenate([d for _, d, _ in found]) if found else [])


def _scan(points: DataFrame, queries: list[tuple[int, bytes]], width: int, k: int) -> DataFrame:
    """Local nearest of a bounded list of queries in every partition of points."""
    qs = [(i, matrix([v], width)[0]) for i, v in queries]

    def run(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            x, ids = matrix(b.column(1), width), np.asarray(b.column(0))
            for i, q in qs:
                d, n = _nearest(x, ids, q, i, k)
                if i in best:
                    d, n = np.concatenate([best[i][0], d]), np.concatenate([best[i][1], n])
                    o = np.lexsort((n, d))[:k]
                    d, n = d[o], n[o]
                best[i] = (d, n)
        yield _hits([(i, d, n) for i, (d, n) in best.items()])

    return arrow_pass(points.select("vec_id", "vec"), run, "query_id long, vec_id long, score double")


def _blocks(points: DataFrame, queries: DataFrame, keys: list[str], width: int, k: int, directions: np.ndarray) -> DataFrame:
    """Nearest rows of each query within groups: points (keys.., vec_id, vec), queries (keys.., query_id, qvec, tree, depth)."""

    def run(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_batches([], _HIT)
        x, ids = matrix(left.column("vec"), width), np.asarray(left.column("vec_id"))
        tree = right.column("tree")[0].as_py()
        if tree >= 0:
            s = strings(x, directions)[:, tree]
            order = np.argsort(s, kind="stable")
            x, ids, s = x[order], ids[order], s[order]
        q = matrix(right.column("qvec"), width)
        once = len(np.unique(ids)) == len(ids)
        found = []
        for i, own, depth in zip(range(len(q)), right.column("query_id").to_pylist(), right.column("depth").to_pylist(), strict=True):
            a, b = 0, len(x)
            if tree >= 0:
                low = int(strings(q[i : i + 1], directions)[0, tree]) >> (LENGTH - depth) << (LENGTH - depth)
                a, b = np.searchsorted(s, [low, low + (1 << (LENGTH - depth))])
            if a < b:
                found.append((own, *_nearest(x[a:b], ids[a:b], q[i], own, k, once)))
        return pa.Table.from_batches([_hits(found)], _HIT)

    return points.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score double")


def search(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows found nearest to each row whose id is divisible by `every`."""
    spark = table.sparkSession
    ws = Workspace(spark, "forest")
    read_in = ws.save(read(table, id_col, vec_col).distinct())
    total, size = common_width(read_in)
    rows = read_in.where(F.length("vec") == size)
    empty = rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    if not total:
        return empty
    width = size // component_bytes(table, vec_col)
    # one point for equal vectors; no query needs more than the k + 1 smallest ids of a point
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    points = ws.save(rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth"))
    queries = ws.save(rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec")))
    sample = [(r.query_id, bytes(r.qvec)) for r in queries.orderBy(F.xxhash64("query_id"), "query_id").limit(SAMPLE).collect()]
    if not sample:
        return empty
    directions = _directions(width)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def top(hits: DataFrame) -> DataFrame:
        near = hits.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))  # the nearest of vectors that share an id
        return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    # histogram of strings
    counted = pa.schema([("tree", pa.int32()), ("s", pa.int32()), ("n", pa.int64())])

    def histogram(batches):
        n = np.zeros(TREES << LENGTH, np.int64)
        for b in batches:
            s = strings(matrix(b.column(0), width), directions) + (np.arange(TREES) << LENGTH)
            n += np.bincount(s.ravel(), minlength=len(n))
        some = np.flatnonzero(n)
        yield tk.batch(counted, tree=some >> LENGTH, s=some & ((1 << LENGTH) - 1), n=n[some])

    def cumulated(vectors: DataFrame) -> np.ndarray:
        h = arrow_pass(vectors, histogram, "tree int, s int, n long").groupBy("tree", "s").agg(F.sum("n").alias("n")).toArrow()
        hist = np.zeros((TREES, (1 << LENGTH) + 1), np.int64)
        hist[np.asarray(h.column("tree")), np.asarray(h.column("s")) + 1] = np.asarray(h.column("n"))
        return hist.cumsum(axis=1)

    below, asked = cumulated(points.select("vec")), cumulated(queries.select("qvec"))

    def counts(q: np.ndarray) -> np.ndarray:
        """Rows that share each query's prefix over all trees, for depths 0 to LENGTH."""
        s = strings(q, directions)
        out = []
        for depth in range(LENGTH + 1):
            low = s >> (LENGTH - depth) << (LENGTH - depth)
            t = np.arange(TREES)[None, :]
            out.append((below[t, low + (1 << (LENGTH - depth))] - below[t, low]).sum(axis=1))
        return np.stack(out, 1)

    # the least `want` at which the sample's true neighbours are found
    truth = top(_scan(points, sample, width, k)).join(points.withColumnRenamed("vec", "near"), "vec_id").select("query_id", "near").collect()
    vec = dict(sample)
    own = matrix([vec[r.query_id] for r in truth], width)
    near = matrix([bytes(r.near) for r in truth], width)
    apart = strings(own, directions) ^ strings(near, directions)
    shared = (LENGTH - np.ceil(np.log2(apart + 1))).max(axis=1) if len(truth) else np.zeros(0)
    n_at = counts(own)
    want = TREES * total
    for w in sorted({int(x) for x in np.geomspace(TREES * (k + 1), max(TREES * (k + 2), TREES * total + 1), 60)}):
        depth = (n_at >= w).sum(axis=1) - 1
        if (shared >= depth).mean() >= FOUND if len(truth) else True:
            want = w
            break

    placed = pa.schema([("query_id", pa.int64()), ("qvec", pa.binary()), ("depth", pa.int32())])

    def place(batches):
        for b in batches:
            depth = np.maximum((counts(matrix(b.column(1), width)) >= want).sum(axis=1) - 1, 0) if b.num_rows else []
            yield tk.batch(placed, query_id=b.column(0), qvec=b.column(1), depth=depth)

    deep = ws.save(arrow_pass(queries, place, "query_id long, qvec binary, depth int"))
    by_depth = {r["depth"]: r["count"] for r in deep.groupBy("depth").count().collect()}
    base, passed = 0, 0
    for d in sorted(by_depth):
        if passed + by_depth[d] > 0.01 * sum(by_depth.values()):
            base = d
            break
        passed += by_depth[d]
    # the grid of each group: parts of rows and parts of queries, TREES * 2**LENGTH numbers at most
    parts, shares = (np.ceil(np.diff(x[:, :: 1 << (LENGTH - base)], axis=1) / n).astype(np.int32).clip(1) for x, n in ((below, BLOCK), (asked, QUERIES)))
    prefix_of = pa.schema([("id", pa.int64()), ("v", pa.binary()), *((c, pa.list_(pa.int32())) for c in ("p", "m", "q"))])

    def prefixes(batches):
        for b in batches:
            p = (strings(matrix(b.column(1), width), directions) >> (LENGTH - base)) if b.num_rows else np.zeros((0, TREES), int)
            yield tk.batch(prefix_of, id=b.column(0), v=b.column(1), p=p.tolist(), m=parts[np.arange(TREES), p].tolist(), q=shares[np.arange(TREES), p].tolist())

    def spread(df: DataFrame) -> DataFrame:
        each = arrow_pass(df, prefixes, "id long, v binary, p array<int>, m array<int>, q array<int>").select("id", "v", F.posexplode(F.arrays_zip("p", "m", "q")).alias("tree", "g"))
        return each.select("id", "v", "tree", F.col("g.p").alias("prefix"), F.col("g.m").alias("m"), F.col("g.q").alias("q"))

    def dealt(n: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    def all_of(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def against_all(some: DataFrame) -> DataFrame:
        grid = [F.lit(math.ceil(total / BLOCK)).alias("m"), F.lit(math.ceil(asked[0, -1] / QUERIES)).alias("q")]
        left = points.select(F.col("vec_id").alias("id"), "vec", *grid).select(dealt("m").alias("part"), all_of("q").alias("share"), F.col("id").alias("vec_id"), "vec")
        right = some.select(F.col("query_id").alias("id"), "qvec", *grid).select(dealt("q").alias("share"), all_of("m").alias("part"), F.col("id").alias("query_id"), "qvec", F.lit(-1).alias("tree"), F.lit(0).alias("depth"))
        return _blocks(left, right, ["part", "share"], width, k, directions)

    hits = []
    if base > 0:
        left = spread(points.select("vec_id", "vec")).select("tree", "prefix", dealt("m").alias("part"), all_of("q").alias("share"), F.col("id").alias("vec_id"), F.col("v").alias("vec"))
        right = spread(deep.where(F.col("depth") >= base).select("query_id", "qvec")).select("id", "v", "tree", "prefix", dealt("q").alias("share"), all_of("m").alias("part"))
        depths = deep.select(F.col("query_id").alias("own"), F.col("qvec").alias("own_vec"), "depth")
        right = right.join(depths, (F.col("id") == F.col("own")) & (F.col("v") == F.col("own_vec"))).select("tree", "prefix", "part", "share", F.col("id").alias("query_id"), F.col("v").alias("qvec"), "depth")
        hits.append(_blocks(left, right, ["tree", "prefix", "part", "share"], width, k, directions))
    if base == 0 or passed:
        hits.append(against_all(deep.where(F.col("depth") < base) if base > 0 else deep))
    found = ws.save(top(hits[0] if len(hits) == 1 else hits[0].union(hits[1])))
    short = deep.join(found.where(F.col("rank") == k).select("query_id"), "query_id", "left_anti")
    if total > k and not short.isEmpty():
        found = found.join(short.select("query_id").distinct(), "query_id", "left_anti").union(top(against_all(short)).select(*found.columns))
    else:
        ws.drop(points, deep)
    return found.select("query_id", "rank", "vec_id", "score")
