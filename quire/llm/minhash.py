"""MinHash near-duplicates by a signature-coordinate inverted join.

Each distinct shingle set is signed with COORDS coordinates and posted under every (coordinate, value). A coordinate
value that one set alone has can collide with nothing, so merging skips its list; a set with fewer than `need` shared
values can reach the match threshold with no other and drops out whole (skip). What is left is ordered from rare to
frequent values, and only the first COORDS - need + 1 of that order are joined: two sets that agree in `need` coordinates
share one of those (prefix). Collisions are then counted over whole signatures, pairs from `need` on are retained, and the
links are confirmed on the full shingle sets, recomputed from the texts.

Only components are asked for, so a list of similar sets is not expanded into pairs. In each list every set is first
held against one centre (the set with the most frequent values, which in a family of copies is the nearest to all). What
a list still holds apart is then compared across components, a pair of blocks of about BLOCK sets or MASS shingles at a
time: first by signatures alone; the texts of sets that are left are joined then, and confirmed by products of indicator
matrices. A block pair gives the links of a spanning forest, so that no link between candidates goes missing and none is
written that components do not need.

Two sets of similarity s agree in a binomial number of COORDS coordinates; `need` lies 3.5 standard deviations below the
mean at the threshold (44 of 64 at 0.85, 40 at 0.8), so that one pair at the threshold falls short with a chance of about
2e-4, and a component is lost only if all its pairs do.

Defined results: null and empty texts have no shingles and are linked with nothing; exact copies (and all texts with the
same shingle set) are one class whatever their number; rows with a null id are linked like others but never lend an id: a
component's id is the smallest id that is not null, null if there is none (ids lie below 2**62). Extra columns are not
read. Rows that repeat an id with different texts count as one node that has both texts' links. An empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import textkit as tk
from quire.llm.common import Workspace, arrow_pass
from quire.llm.components import components

SHINGLE = 5
COORDS = 64
#: Sets of one list that are compared with one another in one task.
BLOCK = 512
MASS = 1 << 20
#: Bytes of text that are hashed at once; the arrays take some twenty times as much.
SLICE = 1 << 18
#: Nodes of rows without an id begin here.
_NAMELESS = 1 << 62

_U = np.uint64
_MULT = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, COORDS, dtype=_U) | _U(1)
_PLACE = np.random.Generator(np.random.PCG64(11)).integers(0, 2**64, 64, dtype=_U) | _U(1)


def shingle_sets(col: pa.Array):
    """Sorted distinct shingle hashes of each row, in row order."""
    for a, b, buf, off in tk.slices(col, SLICE):
        low = tk.LOWER[buf]
        s, e, at = tk.word_spans(low, off)
        w = tk.span_hash(tk.prefix_hash(low), s, e)
        n = len(w)
        if n >= SHINGLE:
            sh = np.zeros(n - SHINGLE + 1, _U)
            for j in range(SHINGLE):
                sh += w[j : n - SHINGLE + 1 + j] * _PLACE[j]
            sh = tk.mix(sh)
        for k in range(b - a):
            i, j = at[k], at[k + 1]
            if j - i >= SHINGLE:
                yield np.unique(sh[i : j - SHINGLE + 1])
            elif j > i:
                yield tk.mix((w[i:j] * _PLACE[: j - i]).sum(dtype=_U, keepdims=True) + _U(j - i))
            else:
                yield np.zeros(0, _U)


def _signature(sh: np.ndarray) -> np.ndarray:
    sig = np.full(COORDS, 2**64 - 1, _U)
    for i in range(0, len(sh), 512):
        np.minimum(sig, (sh[i : i + 512, None] * _MULT[None, :]).min(axis=0), out=sig)
    return (tk.mix(sig) >> _U(32)).astype(np.uint32)


def _node(id_col: str, text_col: str) -> Column:
    """The id, or for rows without one a number above all ids that depends on the text."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(_NAMELESS) + F.xxhash64(F.col(text_col)).bitwiseAND(F.lit((1 << 61) - 1)))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, n_shingles, fp1, fp2, sig) of every row; sig is COORDS little-endian 32-bit values, null for an empty set."""
    out = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("n_shingles", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("sig", pa.binary())])

    def run(batches):
        for b in batches:
            n, f1, f2, sig = [], [], [], []
            for sh in shingle_sets(b.column(2)):
                n.append(len(sh))
                f1.append(int(sh.sum(dtype=_U).astype(np.int64)))
                f2.append(int(tk.mix(sh + _U(1)).sum(dtype=_U).astype(np.int64)))
                sig.append(_signature(sh).tobytes() if len(sh) else None)
            yield tk.batch(out, doc_id=b.column(0), node=b.column(1), n_shingles=n, fp1=f1, fp2=f2, sig=sig)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), _node(id_col, text_col).alias("node"), F.col(text_col).alias("text"))
    return arrow_pass(src, run, "doc_id long, node long, n_shingles long, fp1 long, fp2 long, sig binary")


def _matches(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x == y).sum(axis=-1)


def needed(threshold: tuple[int, int]) -> int:
    s = threshold[0] / threshold[1]
    return max(1, int(COORDS * s - 3.5 * math.sqrt(COORDS * s * (1 - s))))


def _posts(ws: Workspace, sigs: DataFrame, need: int) -> DataFrame:
    """(token, rep, weight): the joined prefix of each set that can still reach `need`."""
    values = pa.schema([("rep", pa.int64()), ("token", pa.int64())])

    def spread(batches):
        place = np.arange(COORDS, dtype=_U) << _U(32)
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4").reshape(-1, COORDS)
            tok = tk.mix(sig.astype(_U) + place).astype(np.int64).ravel()
            yield tk.batch(values, rep=np.repeat(np.asarray(b.column(0)), COORDS), token=tok)

    tokens = arrow_pass(sigs.select("rep", "sig"), spread, "rep long, token long")
    df = tokens.groupBy("token").count().where("count > 1")
    shared = tokens.join(df, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("count", "token"))).alias("t"), F.sum(F.log("count")).alias("weight"))
    prefix = shared.where(F.size("t") >= need).select("rep", "weight", F.explode(F.slice("t", F.lit(1), F.size("t") - (need - 1))).alias("t"))
    return ws.save(prefix.select(F.col("t.token").alias("token"), "rep", "weight"))


def _confirm(ws: Workspace, pairs: DataFrame, sigs: DataFrame, bodies: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Of pairs (a, b): those that agree in `need` coordinates and whose full sets reach the threshold."""
    need, (num, den) = needed(threshold), threshold
    near = (
        pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a")
        .join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
    )
    two = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def count(batches):
        for x in batches:
            sa, sb = (np.frombuffer(b"".join(x.column(i).to_pylist()), "<u4").reshape(-1, COORDS) for i in (2, 3))
            m = pa.array(_matches(sa, sb) >= need)
            yield pa.RecordBatch.from_arrays([x.column(0).filter(m), x.column(1).filter(m)], schema=two)

    kept = ws.save(arrow_pass(near.select("a", "b", "sa", "sb"), count, "a long, b long"))

    def exact(batches):
        for x in batches:
            last, own = None, None
            ok = []
            for ta, tb in zip(x.column(2), x.column(3), strict=True):
                sa = last if own == ta else next(shingle_sets(pa.array([ta.as_py()])))
                last, own = sa, ta
                sb = next(shingle_sets(pa.array([tb.as_py()])))
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                ok.append(den * both >= num * (len(sa) + len(sb) - both))
            m = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column(0).filter(m), x.column(1).filter(m)], schema=two)

    full = kept.join(bodies.toDF("b", "tb"), "b").join(bodies.toDF("a", "ta"), "a").select("a", "b", "ta", "tb")
    out = ws.save(arrow_pass(full, exact, "a long, b long"))
    ws.drop(kept)
    return out


def _apart(ws: Workspace, posts: DataFrame, comp: DataFrame) -> DataFrame:
    """Posts of the lists that hold sets of more than one component, with each set's component."""
    now = posts.join(comp, F.col("rep") == F.col("node"), "left").select("token", "rep", "weight", F.coalesce("component", "rep").alias("comp"))
    mixed = now.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("token", "size")
    return ws.save(now.join(mixed, "token"))


def _forest(n: int, link: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of n nodes under a boolean link matrix."""
    top = np.arange(n)
    out = []
    for i in range(n):
        for j in np.flatnonzero(link[i] & (top != top[i])):
            if top[i] != top[j]:
                out.append((i, int(j)))
                top[top == top[j]] = top[i]
    return out


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as products of the sets' indicator matrix, some thousand shingles at a time."""
    n = len(sets)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    use = count[col] > 1
    row, col = row[use], shared[col[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((n, n), np.float32)
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, 8192):
        i, j = np.searchsorted(col, (c, c + 8192))
        m = np.zeros((n, min(8192, int(col[-1]) + 1 - c)), np.float32)
        m[row[i:j], col[i:j] - c] = 1
        both += m @ m.T
    both[np.arange(n), np.arange(n)] = [len(x) for x in sets]
    return both.astype(np.int64)


def _items(ws: Workspace, apart: DataFrame) -> DataFrame:
    """(item, rep, comp): the rows of each pair of blocks that have to meet, from apart (token, rep, comp, n).

    In a list a component of more than a block is a unit of its own, whose rows need not meet one another; all smaller ones
    are one unit. So a family that fills a list is held against the few that are not of it, not against itself."""
    many = lambda c, m: (F.col(c) > BLOCK) | (F.col(m) > MASS)
    each = apart.groupBy("token", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("m"))
    each = each.select("token", "comp", "c", "m", (~many("c", "m")).alias("pool"), F.when(many("c", "m"), F.col("comp")).otherwise(F.lit(0)).alias("unit"))
    units = each.groupBy("token", "pool", "unit").agg(F.sum("c").alias("c"), F.sum("m").alias("m"))
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK), F.least("c", F.ceil(F.col("m") / MASS)))
    units = ws.save(units.select("token", F.struct("pool", "unit").alias("u"), blocks.alias("nb")))
    one, two = units.toDF("token", "u1", "n1"), units.toDF("token", "u2", "n2")
    pairs = one.join(two, "token").where((F.col("u1") < F.col("u2")) | (F.col("u1") == F.col("u2")) & F.col("u1.pool"))
    rows = apart.join(each.select("token", "comp", F.struct("pool", "unit").alias("u")), ["token", "comp"])

    def side(own: int, other: int) -> DataFrame:
        met = rows.join(pairs.withColumnRenamed(f"u{own}", "u"), ["token", "u"])
        if own == 2:
            met = met.where(F.col("u1") != F.col("u"))  # of a unit with itself one side tells all
        block = F.pmod(F.xxhash64("rep"), F.col(f"n{own}"))
        met = met.select("token", "rep", "comp", F.col("u").alias(f"u{own}"), f"u{other}", block.alias(f"b{own}"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n{other}") - 1)).alias(f"b{other}"))
        same = F.col("u1") == F.col("u2")
        low, high = F.least("b1", "b2"), F.greatest("b1", "b2")
        names = ["token", "u1.pool", "u1.unit", "u2.pool", "u2.unit"]
        item = F.concat_ws(":", *[F.col(c).cast("string") for c in names], F.when(same, low).otherwise(F.col("b1")).cast("string"), F.when(same, high).otherwise(F.col("b2")).cast("string"))
        return met.select(item.alias("item"), "rep", "comp")

    return side(1, 2).union(side(2, 1))


def _across(ws: Workspace, apart: DataFrame, sigs: DataFrame, bodies: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links (a, b) that join what lists still hold apart, confirmed on full sets; of each block pair only a spanning forest."""
    items = _items(ws, apart.join(sigs.select("rep", "n"), "rep"))
    keyed = pa.schema([("item", pa.string()), ("rep", pa.int64()), ("comp", pa.int64())])
    two = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    need, (num, den) = needed(threshold), threshold

    def collide(t: pa.Table) -> pa.Table:
        comp = np.asarray(t.column("comp"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u4").reshape(-1, COORDS)
        some = [k for k in range(len(sig)) if ((_matches(sig, sig[k]) >= need) & (comp != comp[k])).any()]
        return t.select(keyed.names).take(pa.array(some, pa.int64())).cast(keyed)

    left = ws.save(items.join(sigs.select("rep", "sig"), "rep").groupBy("item").applyInArrow(collide, "item string, rep long, comp long"))

    def confirm(t: pa.Table) -> pa.Table:
        rep, comp = (np.asarray(t.column(k)) for k in ("rep", "comp"))
        sets = list(shingle_sets(t.column("text")))
        both = _common(sets)
        size = np.array([len(x) for x in sets])
        link = (comp[:, None] != comp[None, :]) & (den * both >= num * (size[:, None] + size[None, :] - both))
        found = [(rep[i], rep[j]) for i, j in _forest(len(sets), link)]
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], schema=two)

    links = ws.save(left.join(bodies, "rep").groupBy("item").applyInArrow(confirm, "a long, b long").distinct())
    ws.drop(left, apart)
    return links


def _grouped(docs: DataFrame, id_col: str, text_col: str, threshold: tuple[int, int], name: str) -> DataFrame:
    """(doc_id, node, n_shingles, top) of every row: top is the smallest node of its component."""
    ws = Workspace(docs.sparkSession, name)
    every = ws.save(signatures(docs, id_col, text_col))
    known = every.where("n_shingles > 0")
    classes = ws.save(known.groupBy("fp1", "fp2", "n_shingles").agg(F.min("node").alias("rep")))
    one = known.join(classes.select("rep").distinct(), F.col("node") == F.col("rep"), "left_semi")
    first = ws.save(one.select(F.col("node").alias("rep"), "sig", F.col("n_shingles").alias("n")).dropDuplicates(["rep", "sig"]))
    texts = docs.select(_node(id_col, text_col).alias("rep"), F.col(text_col).alias("text"))
    posts = _posts(ws, first, needed(threshold))
    able = posts.select(F.col("rep").alias("able")).distinct()
    bodies = ws.save(texts.join(able, F.col("rep") == F.col("able"), "left_semi").dropDuplicates())
    sigs = ws.save(first.join(able, F.col("rep") == F.col("able"), "left_semi"))
    comp = posts.select(F.col("rep").alias("node"), F.col("rep").alias("component")).limit(0)
    centre = posts.groupBy("token").agg(F.max(F.struct("weight", "rep")).alias("c")).select("token", F.col("c.rep").alias("centre"))
    found = posts.join(centre, "token").where("rep <> centre")
    pairs = ws.save(found.select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct())
    if not pairs.isEmpty():
        stars = _confirm(ws, pairs, sigs, bodies, threshold)
        comp = components(ws, stars)
        links = _across(ws, _apart(ws, posts, comp), sigs, bodies, threshold)
        if not links.isEmpty():
            comp = components(ws, links.union(comp.toDF("a", "b")))
        ws.drop(stars, links)
    top = ws.save(classes.join(comp, F.col("rep") == F.col("node"), "left").select("fp1", "fp2", F.col("n_shingles").alias("n"), F.coalesce("component", "rep").alias("top")))
    ws.drop(classes, first, posts, bodies, sigs, pairs)
    out = every.withColumnsRenamed({"fp1": "f1", "fp2": "f2"}).join(top, (F.col("f1") == F.col("fp1")) & (F.col("f2") == F.col("fp2")) & (F.col("n") == F.col("n_shingles")), "left")
    return out.select("doc_id", "node", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("node")).otherwise(F.col("top")).alias("top"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (85, 100), name: str = "near") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs. threshold: (numerator, denominator) of the least
    similarity, which the signatures are long enough for from about 0.7 on."""
    own = F.when(F.col("top") < _NAMELESS, F.col("top"))
    return _grouped(docs, id_col, text_col, threshold, name).select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """docs, all columns, with one row of each component: the one with the smallest id. Rows without an id take part and
    stay only if no row with an id is like them (of several such rows alike, one stays); of rows that repeat an id one
    stays; texts without words all stay."""
    keyed = docs.withColumn("quire_id", _node(id_col, text_col))
    kept = _grouped(keyed, "quire_id", text_col, threshold, "dedup").where("node = top").select(F.col("node").alias("quire_kept")).distinct()
    return keyed.join(kept, F.col("quire_id") == F.col("quire_kept"), "left_semi").dropDuplicates(["quire_id"]).drop("quire_id")
