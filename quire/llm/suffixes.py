"""Suffix-array deduplication by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every byte that lies in a string of `size` bytes (SIZE unless told otherwise) which also starts elsewhere is removed. Four
steps:

1. Anchors. Of any `span` consecutive grams of `size - span + 1` bytes, the one with the smallest hash is an anchor of every
   `size`-byte string around it; equal strings have equal anchors. A string can only repeat if its anchor does, in another
   text or at another place, so only stretches whose anchors repeat go on, in pieces of PIECE starts at most. Counts are
   combined before the shuffle.
2. Blocks. The stretches are dealt out by range of their smallest anchor (and text, so that a stretch that very many texts
   share is spread), in blocks of about BLOCK bytes. Each block is suffix-sorted to `size` symbols and transformed. Breadth-first
   backward extension then derives the common prefixes by increasing value, beginning with the empty string: an interval
   of suffixes that start with w is extended to those that start with cw, and the end of a new interval is a place where
   neighbours have fewer than len(w) + 1 symbols in common. It stops at `size`; places not reached by then lie between
   suffixes with `size` or more symbols in common, and those runs are the repeated strings.
3. Across blocks. Where a block does not hold all occurrences of an anchor, its strings with that anchor meet those of
   other blocks by their fingerprint (the anchor and a 64-bit hash of the string); one row for each string of a block.
4. Spans are joined to their texts, covered bytes removed.

Exact copies (known by a 128-bit digest) are one text: with `size` bytes or more they repeat whole, so all their bytes go
and no span is needed.

Defined results: null counts as an empty text; texts shorter than `size` keep everything; matches never cross texts; ids may
be null or repeat, each row gives a row; extra columns are not read by spans() and kept by drop_repeats().
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import textkit as tk
from quire.llm.common import Workspace, arrow_pass, bloom_filters

SIZE = 400
BLOCK = 1 << 20
#: Starts of one piece of a stretch.
PIECE = 1 << 20
#: A total that no block can reach.
_OPEN = 1 << 62
_U = np.uint64


def _span(size: int) -> int:
    return size * 16 // 25  # 256 of 400: anchors are rare, and the grams between them long enough to be rare, too


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of `width` values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = op(x[: len(x) - step], x[step:])
        done += step
    return x


def anchors(buf: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a string of `size` bytes its anchor's hash, and the hashes at the distinct anchor places. Empty
    arrays for texts that are shorter."""
    span = _span(size)
    if len(buf) < size:
        return np.zeros(0, _U), np.zeros(0, _U)
    h = tk.window_hash(tk.prefix_hash(buf), size - span + 1)
    low = _sliding(h, span, np.minimum)
    # a gram is an anchor if the largest minimum of the runs it lies in is its own hash
    edge = np.zeros(span - 1, _U)
    high = _sliding(np.concatenate([edge, low, edge]), span, np.maximum)
    return low, h[h == high]


def repeated_runs(text: np.ndarray, limit: int) -> np.ndarray:
    """Class of each suffix of text (symbols, 0 ends a stretch) by its first `limit` symbols: suffixes of one class agree in them."""
    n = len(text)
    # suffix order to `limit` symbols: first by as many symbols as a word holds, then by two or three ranks at a time
    have = np.bincount(text, minlength=2) > 0
    have[0] = True
    dense = (np.cumsum(have) - 1)[text]
    bits = max(1, int(dense.max()).bit_length())
    depth = 63 // bits
    pad = np.concatenate([dense, np.zeros(depth, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key = key << bits | pad[k : k + n]
    width = n.bit_length()
    while True:
        sa = np.argsort(key)
        if depth >= limit:
            break
        key = key[sa]
        new = np.ones(n, bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        place = np.cumsum(new)
        if place[-1] == n:
            break
        rank = np.zeros(n + 2 * depth, np.int64)
        rank[sa] = place
        key = rank[:n] << width | rank[depth : depth + n]
        if 3 * width < 64:
            key = key << width | rank[2 * depth : 2 * depth + n]
            depth *= 3
        else:
            depth *= 2
    # transform: the symbol before each suffix, and where prepending it leads
    bwt = text[sa - 1]
    back = np.empty(n, np.int64)
    back[np.argsort(bwt, kind="stable")] = np.arange(n)
    reached = np.zeros(n + 1, bool)
    reached[[0, n]] = True
    left, right = np.array([0]), np.array([n])
    for _ in range(limit):
        size = right - left
        one = size == 1
        i = left[one]
        i = i[bwt[i] > 0]
        a, b = [back[i]], [back[i] + 1]
        lo, many = left[~one], size[~one]
        if len(lo):
            first = np.cumsum(many) - many
            at = np.repeat(lo - first, many) + np.arange(int(many.sum()))
            of = np.repeat(np.arange(len(lo)), many)
            keep = (bwt[at] > 0) | (len(left) == 1 and right[0] == n)
            at, of = at[keep], of[keep]
            to = back[at]
            order = np.argsort(of * n + to)
            of, to, sym = of[order], to[order], bwt[at[order]]
            start = np.ones(len(to), bool)
            start[1:] = (of[1:] != of[:-1]) | (sym[1:] != sym[:-1])
            s = np.flatnonzero(start)
            a.append(to[s])
            b.append(to[np.concatenate([s[1:], [len(to)]]) - 1] + 1 if len(s) else to[s])
        a, b = np.concatenate(a), np.concatenate(b)
        new = ~reached[b]
        left, right = a[new], b[new]
        # several new intervals cannot end at one place: they are disjoint
        reached[right] = True
        if not len(left):
            break
    out = np.empty(n, np.int64)
    out[sa] = np.cumsum(reached[:-1])
    return out


_PARTS = pa.schema([("text_key", pa.binary()), ("first", pa.int64()), ("stretch", pa.binary()), ("route", pa.int64()), ("anchors", pa.binary()), ("totals", pa.binary())])
_FOUND = pa.schema([("text_key", pa.binary()), ("first", pa.int64()), ("last", pa.int64()), ("anchor", pa.int64()), ("string", pa.int64())])
_MARKS = pa.schema([("anchor", pa.int64()), ("text_key", pa.binary()), ("row_key", pa.int64()), ("m", pa.int64())])


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of true values."""
    d = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1) - 1


class _Finder:
    """The passes over texts and blocks, for strings of `size` bytes."""

    def __init__(self, size: int):
        self.size, self.piece, self.block = size, PIECE, BLOCK

    def mark(self, batches):
        """Rows (text_key, row_key, text) to the anchors of each text and how often it has them."""
        for b in batches:
            hashes, times, row = [], [], []
            for i, j, buf, off in tk.slices(b.column(2)):
                for k in range(i, j):
                    a, m = np.unique(anchors(buf[off[k - i] : off[k - i + 1]], self.size)[1], return_counts=True)
                    hashes.append(a.view(np.int64))
                    times.append(m)
                    row.append(np.full(len(a), k))
            if row:
                of = pa.array(np.concatenate(row))
                yield tk.batch(_MARKS, anchor=np.concatenate(hashes), text_key=b.column(0).take(of), row_key=b.column(1).take(of), m=np.concatenate(times))

    def stretches(self, batches):
        """Rows (text_key, text, shared anchors, totals) to the stretches whose anchors are among the shared ones, in pieces.

        Strings to both sides of a piece's end may have one anchor; no block can know whether it holds all of that one."""
        for b in batches:
            out = [[] for _ in _PARTS]
            for key, text, have, total in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                buf = np.frombuffer(text.encode() if isinstance(text, str) else text, np.uint8)
                low, _ = anchors(buf, self.size)
                have, total = np.array(have, np.int64).view(_U), np.array(total, np.int64)
                order = np.argsort(have)
                have, total = have[order], total[order]
                at = np.minimum(np.searchsorted(have, low), len(have) - 1)
                for first, last in zip(*_runs(have[at] == low), strict=True):
                    for i in range(first, last + 1, self.piece):
                        j = min(i + self.piece - 1, last)
                        own = np.unique(at[i : j + 1])
                        count = total[own]
                        for a, c in ((i - 1, i), (j, j + 1)):
                            if first <= a and c <= last and at[a] == at[c]:
                                count[np.searchsorted(own, at[a])] = _OPEN
                        row = (key, int(i), buf[i : j + self.size].tobytes(), int(have[own[0]] >> _U(1)), have[own].tobytes(), count.tobytes())
                        for c, v in zip(out, row, strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PARTS, strict=True)], schema=_PARTS)

    def _resolve(self, rows: list[tuple]) -> pa.RecordBatch:
        """One block: runs of starts that repeat inside it, and the strings that may repeat in other blocks."""
        bufs = [np.frombuffer(r[2], np.uint8) for r in rows]
        text = np.zeros(sum(map(len, bufs)) + len(bufs), np.int16)
        at, heads = 0, []
        for b in bufs:
            text[at : at + len(b)] = b
            text[at : at + len(b)] += 1
            heads.append(at)
            at += len(b) + 1
        cls = repeated_runs(text, self.size)
        count = np.bincount(cls, minlength=int(cls.max()) + 1)
        marks = [anchors(b, self.size) for b in bufs]
        known = np.unique(np.concatenate([np.frombuffer(r[3], _U) for r in rows]))
        total = np.zeros(len(known), np.int64)
        here = np.zeros(len(known), np.int64)
        for r, (_, places) in zip(rows, marks, strict=True):
            np.maximum.at(total, np.searchsorted(known, np.frombuffer(r[3], _U)), np.frombuffer(r[4], np.int64))
            k = np.minimum(np.searchsorted(known, places), len(known) - 1)
            k = k[known[k] == places]
            np.add.at(here, k, 1)
        shut = here >= total
        out = [[] for _ in _FOUND]
        told = np.zeros(len(count), bool)
        for r, b, head, (low, _) in zip(rows, bufs, heads, marks, strict=True):
            c = cls[head : head + len(low)]
            again = count[c] > 1
            i, j = _runs(again)
            out[0] += [r[0]] * len(i)
            out[1] += (i + r[1]).tolist()
            out[2] += (j + r[1]).tolist()
            out[3] += [None] * len(i)
            out[4] += [None] * len(i)
            loose = np.flatnonzero(~shut[np.searchsorted(known, low)] & (~again | ~told[c]))
            if len(loose):
                loose = loose[np.sort(np.unique(c[loose], return_index=True)[1])]
                told[c[loose]] = True
                name = tk.window_hash(tk.prefix_hash(b), self.size)[loose]
                done = again[loose]
                out[0] += [None if x else r[0] for x in done.tolist()]
                out[1] += np.where(done, -1, loose + r[1]).tolist()
                out[2] += np.where(done, -1, loose + r[1]).tolist()
                out[3] += low[loose].view(np.int64).tolist()
                out[4] += name.view(np.int64).tolist()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _FOUND, strict=True)], schema=_FOUND)

    def blocks(self, batches):
        rows, size = [], 0
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if rows and size + len(r[2]) > self.block:
                    yield self._resolve(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[2])
        if rows:
            yield self._resolve(rows)


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _repeats(ws: Workspace, docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """docs: (row_key, text). Gives (text_key, copies) of texts with copies, and (text_key, spans) of others that repeat in
    part, spans an array of (first, last) starts."""
    find = _Finder(size)
    long_enough = F.length(F.col("text").cast("binary")) >= size
    rows = docs.where(long_enough).select(_key(F.col("text")).alias("text_key"), "row_key", "text")
    copies = ws.save(rows.groupBy("text_key").agg(F.count("*").alias("copies")).where("copies > 1"))
    marks = arrow_pass(rows, find.mark, "anchor long, text_key binary, row_key long, m long")
    marks = ws.save(marks.groupBy("anchor", "text_key").agg(F.min("row_key").alias("row_key"), F.max("m").alias("m")))
    shared = marks.groupBy("anchor").agg(F.sum("m").alias("total")).where("total > 1")
    by_text = marks.join(shared, "anchor").groupBy("text_key").agg(F.min("row_key").alias("row_key"), F.collect_list(F.struct("anchor", "total")).alias("a"))
    by_text = ws.save(by_text.select("text_key", "row_key", F.col("a.anchor").alias("anchors"), F.col("a.total").alias("totals"), F.size("a").alias("n")))
    # a Bloom filter of the texts that go on keeps the others out of the shuffle
    bloom_filters(docs.sparkSession)
    going = rows.withColumnRenamed("text_key", "tk").withColumnRenamed("row_key", "rk").join(by_text.where("n > 0"), (F.col("rk") == F.col("row_key")) & (F.col("tk") == F.col("text_key")))
    parts = arrow_pass(going.select("text_key", "text", "anchors", "totals"), find.stretches, "text_key binary, first long, stretch binary, route long, anchors binary, totals binary")
    # totals count a text once, and rows that repeat a text's least key all join: each stretch goes on once, too
    parts = ws.save(parts.dropDuplicates(["text_key", "first"]))
    ws.drop(marks, by_text)
    length = parts.agg(F.sum(F.length("stretch"))).first()[0] or 0
    dealt = parts.repartitionByRange(max(1, length // (2 * BLOCK) + 1), "route", "text_key", "first").sortWithinPartitions("route", "text_key", "first")
    found = ws.save(arrow_pass(dealt.select("text_key", "first", "stretch", "anchors", "totals"), find.blocks, "text_key binary, first long, last long, anchor long, string long"))
    ws.drop(parts)
    loose = found.where("string is not null")
    several = loose.groupBy("anchor", "string").count().where("count > 1").drop("count")
    across = loose.join(several, ["anchor", "string"]).where("first >= 0").select("text_key", "first", "last")
    spans = found.where("string is null").select("text_key", "first", "last").union(across)
    spans = spans.groupBy("text_key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    spans = ws.save(spans.join(copies, "text_key", "left_anti"))
    ws.drop(found)
    return copies, spans


def covered(spans: list, size: int) -> list[tuple[int, int]]:
    """Maximal removed runs (start, end), from spans of starts."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + size))
        else:
            out.append((a, b + size))
    return out


def cut(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.withColumn("row_key", F.coalesce("doc_id", F.xxhash64("text")))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, for strings of `size` bytes."""
    ws = Workspace(docs.sparkSession, "suffixes")
    src = _prepared(docs, id_col, text_col)
    copies, spans = _repeats(ws, src.select("row_key", "text"), size)
    n = F.length(F.col("text").cast("binary")).cast("long").alias("n_bytes")
    key = _key(F.col("text")).alias("tk")
    slim = src.select("doc_id", key, n, F.sha2("text", 256).alias("sha"))
    touched = copies.select("text_key", F.lit(True).alias("whole")).union(spans.select("text_key", F.lit(False)))
    plain = slim.join(touched, F.col("tk") == F.col("text_key"), "left").where("whole is null or whole")
    nothing = hashlib.sha256(b"").hexdigest()
    plain = plain.select("doc_id", "n_bytes", F.when(F.col("whole"), F.col("n_bytes")).otherwise(0).alias("n_removed"), F.when(F.col("whole"), 1).otherwise(0).cast("long").alias("n_spans"), F.when(F.col("whole"), nothing).otherwise(F.col("sha")).alias("kept_sha256"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def remove(batches):
        for b in batches:
            rows = []
            for doc, text, sp in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.encode()
                runs = covered([(s["first"], s["last"]) for s in sp], size)
                rows.append((doc, len(raw), sum(y - x for x, y in runs), len(runs), hashlib.sha256(cut(raw, runs)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    partly = src.select("doc_id", "text", key).join(spans.where(F.size("spans") > 0), F.col("tk") == F.col("text_key")).select("doc_id", "text", "spans")
    return plain.union(arrow_pass(partly, remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", size: int = SIZE) -> DataFrame:
    """docs, all columns, with the bytes of strings of `size` bytes that repeat removed; characters that a cut splits are
    dropped, texts left empty stay as empty texts. The length column, if given, is renewed (in characters) where a text
    changed. At the sizes in use (200 and 400) an anchor is a gram of 73 or 145 bytes."""
    ws = Workspace(docs.sparkSession, "suffixes")
    copies, spans = _repeats(ws, _prepared(docs, id_col, text_col).select("row_key", "text"), size)
    touched = ws.save(copies.select(F.col("text_key").alias("quire_key"), F.lit(None).cast("array<struct<first:long,last:long>>").alias("quire_spans")).union(spans.select("text_key", "spans")))
    ws.drop(copies, spans)
    names = docs.columns
    keyed = docs.withColumn("quire_own", _key(F.coalesce(F.col(text_col), F.lit(""))))
    joined = keyed.join(touched.withColumn("quire_hit", F.lit(True)), F.col("quire_own") == F.col("quire_key"), "left")
    i, k = names.index(text_col), names.index(length_col) if length_col else None
    schema = docs.schema

    def run(batches):
        for b in batches:
            cols = list(b.columns)[: len(names)]
            text, hit, sp = cols[i].to_pylist(), b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist()
            chars = cols[k].to_pylist() if k is not None else None
            for x in range(len(text)):
                if hit[x]:
                    raw = text[x].encode()
                    text[x] = "" if sp[x] is None else cut(raw, covered([(s["first"], s["last"]) for s in sp[x]], size)).decode("utf-8", "ignore")
                    if chars is not None:
                        chars[x] = len(text[x])
            cols[i] = pa.array(text, b.schema.field(i).type)
            if k is not None:
                cols[k] = pa.array(chars, b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return arrow_pass(joined.select(*[F.col(f"`{c}`") for c in names], "quire_hit", "quire_spans"), run, schema)
