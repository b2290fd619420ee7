"""Toxicity by class-conditional Kneser-Ney models.

Two models over the characters of a text (26 letters and a few classes; runs of other marks are one blank) predict each
symbol from the four before it. Both discount their own counts and give the freed mass to one shared backoff distribution:
continuation counts, i.e. in how many different contexts of either class a symbol followed the last three, smoothed in the
same way by the last two, the last one, none and a uniform floor. So an expression that a class has hardly seen falls back
to what both classes share, and says little. Where neither class has seen a symbol in its context, the backoff cancels from
the ratio and only the two backoff weights are left.

Counts are exact: each context and symbol is a number of 25 bits, nothing shares a slot. What is gathered grows with the
labelled texts, up to the 2**25 events there are; so a model is a table of 64 MB, which is broadcast deflated.

A text's evidence is its log-likelihood ratio by symbol over the whole text, and the same word by word: what distinct words
have beyond BAR, and the strongest of them. A logistic curve makes a probability of these and of the number of words. The
curve is fitted on evidence that each half of the labelled rows gets from models of the other half; the final models count
both halves. In the curve a toxic row weighs COST clean ones, as toxic rows are rare and missing one is worse. At most
`sample_rows` rows fit the curve (a documented bound); tasks make the evidence, the driver gets numbers only.

Defined results: null counts as an empty text; empty texts get the calibrated score of no evidence; without labelled rows
of both classes in both halves every score is the share of toxic rows (0 without labels). Ids may be null or repeat, each
row gives a row; repeated rows all count; extra columns are not read by score() and kept by keep_clean().
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import textkit as tk
from quire.llm.common import arrow_pass, label_sample, labelled

ORDER = 5
EVENTS = 1 << 5 * ORDER
SYMBOLS = 32
DISCOUNT = 2.5  # of a class's own counts; an event seen twice says nothing yet
BACKOFF = 0.75  # of continuation counts
BAR = 2.0
TOP_WORDS = 3
COST = 4.0
CHUNKS = 64
#: Symbols that a task counts before it adds them up.
_BUFFER = 1 << 22
#: Bytes of text that get their evidence at once; the arrays take some thirty times as much.
SLICE = 1 << 18
_FEATURES = 4

_SYM = np.zeros(256, np.uint8)
_SYM[97:123] = np.arange(1, 27)
_SYM[65:91] = np.arange(1, 27)
_SYM[48:58] = 27
_SYM[0xC0:] = 31
_SYM[0x80:0xC0] = 1 + np.arange(64) % 30


def events(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of consecutive texts: the number of each event (context and symbol, five bits each), and where each text's begin
    (len(off) places). Every text begins after blanks and ends with one."""
    rows = len(off) - 1
    s = _SYM[buf]
    first = np.zeros(len(s) + 1, bool)
    first[off] = True
    before = np.concatenate([np.zeros(1, np.uint8), s])[: len(s)]
    before[first[: len(s)]] = 0
    keep = np.flatnonzero((s > 0) | (before > 0))  # one blank after each word
    size = np.diff(np.searchsorted(keep, off))
    pad = ORDER - 1
    begin = np.concatenate([[0], np.cumsum(size + pad + 1)])
    out = np.zeros(begin[-1], np.int32)
    out[np.arange(len(keep)) + np.repeat(np.arange(rows) * (pad + 1) + pad, size)] = s[keep]
    key = np.zeros(max(len(out) - pad, 0), np.int32)
    for k in range(ORDER):
        key = key << 5 | out[k : k + len(key)]
    at = begin - np.arange(rows + 1) * pad
    return key[np.arange(at[-1]) + np.repeat(np.arange(rows) * pad, size + 1)], at


def evidence(table: np.ndarray, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The features of consecutive texts under a table of log ratios, a row each."""
    key, at = events(buf, off)
    rows = len(off) - 1
    r = table[key].astype(np.float64)
    total = np.concatenate([[0.0], np.cumsum(r)])
    ends = np.flatnonzero(key % SYMBOLS == 0) + 1
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    real = ends - starts > 1
    starts, ends = starts[real], ends[real]
    row = np.searchsorted(at, starts, "right") - 1
    word = total[ends] - total[starts]
    words = np.bincount(row, minlength=rows)
    out = np.zeros((rows, _FEATURES))
    out[:, 0] = (total[at[1:]] - total[at[:-1]]) / np.diff(at)
    # a word said again is no new evidence
    far = word > BAR
    said = np.unique(np.stack([row[far], np.round(word[far] * 1000).astype(np.int64)]), axis=1)
    out[:, 1] = np.bincount(said[0], said[1] / 1000 - BAR, rows) / np.sqrt(words + 1)
    by = word / np.sqrt(np.maximum(ends - starts, 4))
    some = by > 0
    said = np.unique(np.stack([row[some], -np.round(by[some] * 1000).astype(np.int64)]), axis=1)
    rank = np.arange(said.shape[1]) - np.searchsorted(said[0], said[0])
    top = said[:, rank < TOP_WORDS]
    out[:, 2] = np.bincount(top[0], -top[1] / 1000, rows) / TOP_WORDS
    out[:, 3] = np.log1p(words)
    return out


def _sum(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of their counts."""
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], np.add.reduceat(n, first) if len(first) else n


def _pack(code: np.ndarray, n: np.ndarray):
    """(chunk, bytes) of sorted codes with counts: distances and counts, column by column, deflated."""
    edge = np.searchsorted(code, np.arange(CHUNKS + 1) * (4 * EVENTS // CHUNKS))
    for c in range(CHUNKS):
        i, j = edge[c], edge[c + 1]
        if i < j:
            own = (np.diff(code[i:j], prepend=0), n[i:j])
            yield c, zlib.compress(b"".join(np.asarray(x, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in own), 1)


def _unpack(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(x), np.uint8)
    step, n = (np.ascontiguousarray(r.reshape(8, -1).T).view("<i8").ravel() for r in raw.reshape(2, -1))
    return np.cumsum(step), n


def log_ratios(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The table of log-likelihood ratios (float16, by event) from sorted event numbers and their counts n[class]."""
    # continuation types by context length: how many different symbols stood before each shorter event
    levels, longer = [], key
    for k in range(ORDER - 1, 0, -1):
        shorter, types = np.unique(longer & ((1 << 5 * k) - 1), return_counts=True)
        levels.append((k, shorter, types.astype(float)))
        longer = shorter
    known, prob = np.zeros(1, np.int64), np.full(1, 1 / SYMBOLS)
    for k, event, types in reversed(levels):
        _, own = np.unique(event >> 5, return_inverse=True)
        total = np.bincount(own, types)
        free = np.bincount(own, np.minimum(types, BACKOFF)) / total
        prob = np.maximum(types - BACKOFF, 0) / total[own] + free[own] * prob[np.searchsorted(known, event & ((1 << 5 * (k - 1)) - 1))]
        known = event
    back = prob[np.searchsorted(known, key & ((1 << 5 * (ORDER - 1)) - 1))]
    context, own = np.unique(key >> 5, return_inverse=True)
    like, free = [], []
    for c in (0, 1):
        less = np.minimum(n[c], DISCOUNT)
        total = np.bincount(own, n[c])
        weight = np.where(total > 0, np.bincount(own, less) / np.maximum(total, 1), 1.0)
        like.append((n[c] - less) / np.maximum(total, 1)[own] + weight[own] * back)
        free.append(weight)
    out = np.zeros((EVENTS // SYMBOLS, SYMBOLS), np.float16)
    out[context] = np.log(free[1] / free[0])[:, None]
    out = out.ravel()
    out[key] = np.log(like[1] / like[0])
    return out


class Table:
    """Log ratios (float16, by event), deflated where they travel; empty without a model."""

    def __init__(self, ratio: np.ndarray):
        self.ratio = ratio

    def __getstate__(self) -> bytes:
        return zlib.compress(self.ratio.tobytes(), 1)

    def __setstate__(self, state: bytes) -> None:
        self.ratio = np.frombuffer(zlib.decompress(state, bufsize=2 * EVENTS), np.float16)


@dataclass
class Model:
    table: Table
    weight: np.ndarray  # of the features and 1
    prior: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The score of each row of an Arrow column of texts."""
        out = np.full(len(texts), self.prior)
        if len(self.table.ratio):
            for a, b, buf, off in tk.slices(texts, SLICE):
                z = evidence(self.table.ratio, buf, off) @ self.weight[:-1] + self.weight[-1]
                out[a:b] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of the features and 1, by Newton steps with a weak pull to zero."""
    mean, sd = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.concatenate([(x - mean) / sd, np.ones((len(x), 1))], 1)
    cost = np.where(y > 0, COST, 1.0)
    w = np.zeros(z.shape[1])
    pull = np.diag([0.3] * (len(w) - 1) + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (cost * p * (1 - p) + 1e-9)[:, None]).T @ z + pull, z.T @ (cost * (p - y)) + pull @ w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-7:
            break
    w[:-1] /= sd
    w[-1] -= w[:-1] @ mean
    return w


def _half(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("half"), F.col(id_col).cast("long")), F.lit(2)).cast("int")


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rows: (text, y, half). Gives sorted event numbers, their counts [half, class], and the number of rows [half, class].

    Tasks add up what they count and send it packed, by chunk of events; what tasks send is added up as it arrives."""
    packed = pa.schema([("chunk", pa.int32()), ("counts", pa.binary())])

    def count(batches):
        sums = (np.zeros(0, np.int32), np.zeros(0, np.int64))
        seen, held, size = np.zeros(4, np.int64), [], 0
        for b in batches:
            kind = np.asarray(b.column(2)) * 2 + np.asarray(b.column(1))
            seen += np.bincount(kind, minlength=4)
            for i, j, buf, off in tk.slices(b.column(0)):
                key, at = events(buf, off)
                held.append(key << 2 | np.repeat(kind[i:j], np.diff(at)).astype(np.int32))
                size += len(key)
            if size > _BUFFER:
                u, n = np.unique(np.concatenate(held), return_counts=True)
                sums, held, size = _sum(np.concatenate([sums[0], u]), np.concatenate([sums[1], n])), [], 0
        if held:
            u, n = np.unique(np.concatenate(held), return_counts=True)
            sums = _sum(np.concatenate([sums[0], u]), np.concatenate([sums[1], n]))
        chunks = [(-1, seen.tobytes()), *_pack(*sums)]
        yield tk.batch(packed, chunk=[c for c, _ in chunks], counts=[x for _, x in chunks])

    summed = pa.schema([("code", pa.int32()), ("n", pa.int64())])

    def add(batches):
        seen, own, at = np.zeros(4, np.int64), np.zeros(4 * EVENTS // CHUNKS, np.int64), -1

        def take():
            some = np.flatnonzero(own)
            for i in range(0, len(some), 1 << 16):
                k = some[i : i + (1 << 16)]
                yield tk.batch(summed, code=k + at * len(own), n=own[k])
            own[:] = 0

        for b in batches:
            for c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if c < 0:
                    seen += np.frombuffer(x, np.int64)
                    continue
                if c != at:
                    yield from take()
                    at = c
                code, n = _unpack(x)
                own[code - c * len(own)] += n
        yield from take()
        yield tk.batch(summed, code=[-4, -3, -2, -1], n=seen)

    parts = arrow_pass(rows, count, "chunk int, counts binary").repartition(CHUNKS // 4, "chunk").sortWithinPartitions("chunk")
    sums = arrow_pass(parts, add, "code int, n long").toArrow()
    code, n = np.asarray(sums.column("code")), np.asarray(sums.column("n"))
    seen = np.bincount(code[code < 0] + 4, n[code < 0], 4).reshape(2, 2)
    code, n = code[code >= 0], n[code >= 0]
    key, at = np.unique(code >> 2, return_inverse=True)
    out = np.zeros((4, len(key)))
    out[code & 3, at] = n
    return key.astype(np.int64), out.reshape(2, 2, -1), seen


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 12000) -> Model:
    """docs and labels share an id; ids without a 0/1 label teach nothing."""
    rows = labelled(docs, labels, id_col, text_col, label_col).select("text", "y", _half("id").alias("half"))
    key, n, seen = _counts(rows)
    prior = float(seen[:, 1].sum() / seen.sum()) if seen.sum() else 0.0
    if not seen.all():
        return Model(Table(np.zeros(0, np.float16)), np.zeros(_FEATURES + 1), prior)
    halves = []
    for h in (0, 1):
        own = n[h].any(axis=0)
        halves.append(docs.sparkSession.sparkContext.broadcast(Table(log_ratios(key[own], n[h][:, own]))))  # of fixed size
    names = [f"x{k}" for k in range(_FEATURES)]
    schema = pa.schema([("id", pa.int64()), ("y", pa.int32()), *((k, pa.float64()) for k in names)])

    def weigh(shared):
        def run(batches):
            for b in batches:
                for a, e, buf, off in tk.slices(b.column(1), SLICE):
                    x = evidence(shared.value.ratio, buf, off)
                    yield tk.batch(schema, id=b.column(0).slice(a, e - a), y=b.column(2).slice(a, e - a), **dict(zip(names, x.T, strict=True)))

        return run

    # a pass for each half, so that a worker holds one table
    picked = label_sample(docs, labels, id_col, text_col, label_col, sample_rows).select("id", "text", "y", _half("id").alias("half"))
    each = [arrow_pass(picked.where(F.col("half") == h).select("id", "text", "y"), weigh(halves[1 - h]), "id long, y int, " + ", ".join(f"{k} double" for k in names)) for h in (0, 1)]
    got = each[0].union(each[1]).orderBy(F.xxhash64("id"), "id", "y", *names).limit(sample_rows).toArrow()
    for shared in halves:
        shared.unpersist()
    x = np.stack([np.asarray(got.column(k)) for k in names], 1)
    return Model(Table(log_ratios(key, n.sum(axis=0))), _curve(x, np.asarray(got.column("y")).astype(float)), prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def run(batches):
        m = shared.value
        for b in batches:
            yield tk.batch(schema, doc_id=b.column(0), score=m.scores(b.column(1)))

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_pass(src, run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", bar: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores below the bar."""
    i = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            yield b.filter(pa.array(m.scores(b.column(i)) < bar, pa.bool_()))

    return arrow_pass(docs, run, docs.schema)
