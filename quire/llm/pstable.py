"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are normalised; two unit vectors of cosine c lie sqrt(2 - 2c) apart. Each of some tables hashes a vector by some
projections on normal directions, shifted and cut into steps of WIDTH; all of a table's numbers together name a bucket.
Vectors that share a bucket in any table are candidates, and their cosine is checked in double precision. The projections
of a table grow with the logarithm of the number of vectors, so that a bucket of unrelated vectors stays small; the tables
grow with them, so that a pair at the threshold is missed with a chance of at most MISS whatever the number of vectors.

A pair is counted in the first table that it shares a bucket in only, so counts of links add up over tables and no pair is
written: a bucket gives each of its vectors a count, and the links of a spanning forest for the components. Equal vectors
are one point with a weight. A large bucket is compared a pair of blocks of BLOCK rows at a time, each in its own task. A
bucket that holds the same vectors as one of an earlier table has nothing new and is left out; of others, vectors that met
in an earlier table's bucket are not multiplied again.

Defined results: vectors that take no part (see vectors.read), and those that differ in width from most (of equally many the
smaller width counts), link with nothing; a row with a null id has component null. Rows that repeat an id are one node for
components, and each counts as a vector of its own. Ties cannot matter. An empty table gives no row; extra columns are not
read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textkit as tk
from quire.llm.common import Workspace, arrow_pass
from quire.llm.components import components
from quire.llm.minhash import _forest
from quire.llm.vectors import common_width, component_bytes, matrix, read

TABLES = 32  # at least
MISS = 1e-3
WIDTH = 2.0
BLOCK = 1024
_U = np.uint64


def projections(n: int) -> int:
    """So many that about 64 of n unrelated vectors share a bucket; one projection leaves about 0.486 of them."""
    return max(6, round(math.log(max(n, 2) / 64) / 0.72)) if n > 64 else 6


def tables(k: int, cosine: float) -> int:
    """So many tables of k projections that two vectors of this cosine share a bucket in none with a chance of MISS at most."""
    far = math.sqrt(max(2 - 2 * cosine, 1e-12))
    r = WIDTH / far
    one = math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))  # chance to share a step
    every = one**k
    return TABLES if every >= 1 - MISS else max(TABLES, math.ceil(math.log(MISS) / math.log1p(-every)))


def buckets(unit: np.ndarray, k: int, count: int) -> np.ndarray:
    """The bucket of each unit vector in each of `count` tables, as a 32-bit number."""
    rng = np.random.Generator(np.random.PCG64(43))
    a = rng.standard_normal((unit.shape[1], count * k))
    step = np.floor((unit @ a + rng.random(count * k) * WIDTH) / WIDTH).astype(np.int64)
    step = step.view(_U).reshape(len(unit), count, k)
    h = np.zeros((len(unit), count), _U)
    for j in range(k):
        h = tk.mix(h + step[:, :, j] * _U(0x9E3779B97F4A7C15) + _U(j + 1))
    return (h >> _U(32)).astype(np.uint32)


def _fresh(v: np.ndarray, h: np.ndarray, t: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit rows with a product of at least `least` that share a bucket in none of the tables before t.

    Many rows are taken in classes, by the earlier table that puts most of them together; rows of one class are not
    multiplied."""
    n = len(v)
    if t and n > 256:
        own = [np.unique(h[:, e], return_inverse=True)[1] for e in range(t)]
        own = own[int(np.argmin([x.max() for x in own]))]
    else:
        own = np.arange(n)
    order = np.argsort(own, kind="stable")
    own, v, h = own[order], v[order], h[order]
    edge = np.concatenate([np.flatnonzero(np.diff(own, prepend=-1)), [n]])
    found = []
    c = 0
    while c < len(edge) - 1:
        last = max(c + 1, int(np.searchsorted(edge, edge[c] + 128, "right")) - 1)  # a large class, or some small ones
        a, b = edge[c], edge[last]
        start = b if last == c + 1 else a
        for r in range(a, b, 512):
            i, j = np.nonzero(v[r : min(r + 512, b)] @ v[start:].T >= least)
            i, j = i + r, j + start
            new = (own[i] != own[j]) & (i < j)
            found.append((i[new], j[new]))
        c = last
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
    for e in range(t):
        new = h[i, e] != h[j, e]
        i, j = i[new], j[new]
    return order[i], order[j]


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    ws = Workspace(table.sparkSession, "pstable")
    every = ws.save(read(table, id_col, vec_col))
    alone = [F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")]
    total, size = common_width(every)
    if not total:
        return every.select("vec_id", *alone)
    usable = F.coalesce(F.length("vec") == size, F.lit(False))
    rows = every.where(usable)
    width = size // component_bytes(table, vec_col)
    points = ws.save(rows.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")))
    k = projections(points.count())
    count = tables(k, threshold)
    hashed = pa.schema([("rep", pa.int64()), ("weight", pa.int64()), ("vec", pa.binary()), ("b", pa.binary())])

    def sign(batches):
        for b in batches:
            x = matrix(b.column(2), width)
            if len(x):
                h = buckets(x / np.sqrt((x * x).sum(axis=1, keepdims=True)), k, count)
                yield tk.batch(hashed, rep=b.column(0), weight=b.column(1), vec=b.column(2), b=[r.tobytes() for r in h.astype("<u4")])

    signed = ws.save(arrow_pass(points.select("rep", "weight", "vec"), sign, "rep long, weight long, vec binary, b binary"))
    each = pa.schema([("rep", pa.int64()), ("t", pa.int32()), ("bucket", pa.int64())])

    def post(batches):
        for b in batches:
            h = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4").reshape(-1, count)
            t = np.tile(np.arange(count, dtype=np.int32), len(h))
            yield tk.batch(each, rep=np.repeat(np.asarray(b.column(0)), count), t=t, bucket=h.ravel().astype(np.int64))

    posts = arrow_pass(signed.select("rep", "b"), post, "rep long, t int, bucket long")
    members = [F.sum(F.xxhash64("rep", F.lit(i)).cast("decimal(38,0)")).alias(f"set{i}") for i in (0, 1)]
    sizes = posts.groupBy("t", "bucket").agg(F.count("*").alias("count"), *members).where("count > 1")
    sizes = sizes.groupBy("count", "set0", "set1").agg(F.min(F.struct("t", "bucket")).alias("first")).select("first.t", "first.bucket", "count")
    shared = posts.join(sizes, ["t", "bucket"]).withColumn("blocks", F.ceil(F.col("count") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    items = shared.select("t", "bucket", "rep", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    items = items.select("t", "bucket", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "rep", "block").join(signed, "rep")
    out = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

    def compare(key, t):
        rep, weight, block = (np.asarray(t.column(c)) for c in ("rep", "weight", "block"))
        v = matrix(t.column("vec"), width)
        v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
        h = np.frombuffer(b"".join(t.column("b").to_pylist()), "<u4").reshape(-1, count)
        table_no, x, y = key[0].as_py(), key[2].as_py(), key[3].as_py()
        i, j = _fresh(v, h, table_no, threshold - 1e-9)
        if x != y:
            i, j = i[block[i] != block[j]], j[block[i] != block[j]]
        exact = (v[i] * v[j]).sum(axis=1) >= threshold
        i, j = i[exact], j[exact]
        n = np.bincount(i, weight[j], len(v)).astype(np.int64) + np.bincount(j, weight[i], len(v)).astype(np.int64)
        link = np.zeros((len(v), len(v)), bool)
        link[i, j] = link[j, i] = True
        some = np.flatnonzero(n)
        pairs = _forest(len(some), link[np.ix_(some, some)])
        a, b = [int(rep[some[p]]) for p, _ in pairs], [int(rep[some[q]]) for _, q in pairs]
        none = [None] * len(some)
        return pa.table([pa.array(np.concatenate([rep[some], np.array(a, np.int64)])), pa.array(n[some].tolist() + [0] * len(a), pa.int64()), pa.array(none + b, pa.int64())], schema=out)

    found = ws.save(items.groupBy("t", "bucket", "x", "y").applyInArrow(compare, "rep long, n long, other long"))
    counts = found.where("other is null").groupBy("rep").agg(F.sum("n").alias("n"))
    ws.drop(signed)
    comp = components(ws, found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    tops = points.join(counts, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    tops = ws.save(tops.select("vec", "weight", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "rep").alias("component_id")))
    ws.drop(points, found)
    linked = rows.join(tops, "vec").select("vec_id", (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.union(every.where(~usable).select("vec_id", *alone))
