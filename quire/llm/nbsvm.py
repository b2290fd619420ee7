"""Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios under a linear hinge loss.

A text's n-grams are its words (one and two) and its characters (CHARS bytes, lower-cased), which can tell
vocabulary; and, so that form shows as well, those of its folded bytes (orders 1 to 4, with digits and lower-case letters
folded) and of its word shapes (orders 1 to 3; a word that repeats the one before has a shape of its own). Indicators are
hashed into BINS features. The log-count ratios come from every labelled row: tasks count their rows per feature and class
before the shuffle, and the driver gets BINS sums at most. The weights are fitted by dual coordinate descent on a sample of
at most `sample_rows` labelled rows (a documented bound), those with the smallest hash of the id, and calibrated to
probabilities on the same sample by a logistic curve of the margin. Tasks make the sample's features; no text goes to the
driver.

Defined results: null counts as an empty text; empty texts have the indicator of no word and get a score like others; with
no labelled row, or with one class only, every score is that class's share (0.5 without labels). Ids may be null or repeat,
each row gives a row; repeated rows all count; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textkit as tk
from quire.llm.common import arrow_pass, label_sample, labelled

BITS = 20
BINS = 1 << BITS
CHARS = 4
_U = np.uint64

# Byte classes of form: letters and digits of a kind are one.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[97:123] = ord("a")
_FOLD[65:91] = ord("A")
_FOLD[48:58] = ord("0")
_FOLD[0x80:0xC0] = 0x80
_FOLD[0xC0:] = 0xC0


def _squash(x: np.ndarray) -> np.ndarray:
    return (tk.mix(x) >> _U(64 - BITS)).astype(np.int32)


_last = np.zeros(BINS, np.int32)


def _distinct(f: np.ndarray) -> np.ndarray:
    """f without repeats: of places with one number the last written stays."""
    place = np.arange(len(f), dtype=np.int32)
    _last[f] = place
    return f[_last[f] == place]


def features(text: bytes | None) -> np.ndarray:
    """Distinct feature numbers of a text."""
    buf = np.frombuffer(text or b"", np.uint8)
    out = []
    folded = _FOLD[buf]
    # runs of one folded byte count once or twice, so that word lengths do not matter
    keep = np.ones(len(folded), bool)
    keep[2:] = (folded[2:] != folded[1:-1]) | (folded[1:-1] != folded[:-2])
    f = folded[keep].astype(_U)
    g = np.zeros(len(f), _U)
    for order in range(1, 5):
        if len(f) < order:
            break
        g = (g[: len(f) - order + 1] << _U(8)) | f[order - 1 :]
        out.append(g | _U(order << 40))
    off = np.array([0, len(buf)])
    s, e, _ = tk.word_spans(buf, off)
    c = tk.prefix_hash(tk.LOWER[buf])
    out.append(tk.window_hash(c, CHARS))
    if len(s):
        w = tk.span_hash(c, s, e)
        out.append(w + _U(1 << 57))
        out.append(w[:-1] * _U(3) + w[1:] + _U(1 << 58))
        size = np.minimum(np.log2((e - s).astype(np.float64) + 1).astype(_U), _U(7))
        upper = (buf[s] >= 65) & (buf[s] <= 90)
        loud = upper & (buf[np.minimum(s + 1, e - 1)] >= 65) & (buf[np.minimum(s + 1, e - 1)] <= 90)
        tail = _FOLD[buf[e - 1]].astype(_U)
        again = np.zeros(len(w), bool)
        again[1:] = w[1:] == w[:-1]
        shape = size | upper.astype(_U) << _U(3) | loud.astype(_U) << _U(4) | again.astype(_U) << _U(5) | tail << _U(6)
        h = np.zeros(len(shape), _U)
        for order in range(1, 4):
            if len(shape) < order:
                break
            h = (h[: len(shape) - order + 1] << _U(14)) | shape[order - 1 :]
            out.append(h | _U((order + 8) << 44))
        # distinct words against words, and repeated neighbours, in steps
        share = len(np.unique(w)) / len(w)
        out.append(np.arange(int(share * 10) + 1, dtype=_U) | _U(1 << 60))
        out.append(np.arange(int(again.mean() * 10) + 1, dtype=_U) | _U(1 << 61))
        out.append(np.arange(int(np.log2(len(w))) + 1, dtype=_U) | _U(1 << 62))
    else:
        out.append(np.array([1 << 63], _U))
    return _distinct(_squash(np.concatenate(out)))


@dataclass
class Model:
    weight: np.ndarray  # float32, BINS: SVM weight times log-count ratio
    bias: float
    slope: float
    offset: float
    prior: float

    def score(self, text: bytes | None) -> float:
        if not len(self.weight):
            return self.prior
        f = features(text)
        margin = float(self.weight[f].sum(dtype=np.float64)) / np.sqrt(len(f)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a weak pull to zero."""
    scale = float(np.std(x)) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.eye(2) * 1e-2
        step = np.linalg.solve(h, z.T @ (p - y) + 1e-2 * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + cost * sum of hinge losses over rows of scaled indicators at unit-length scaling."""
    w, bias = np.zeros(len(scale)), 0.0
    norm = np.array([float(scale[f] @ scale[f]) / len(f) + 1.0 for f in rows])
    share = np.array([(y < 0).mean(), (y > 0).mean()])
    limit = np.where(y > 0, cost * share[0], cost * share[1]) * 2
    alpha = np.zeros(len(rows))
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            f = rows[i]
            v = scale[f] / np.sqrt(len(f))
            grad = y[i] * (float(w[f] @ v) + bias) - 1.0
            new = min(max(alpha[i] - grad / norm[i], 0.0), limit[i])
            d = (new - alpha[i]) * y[i]
            if d:
                alpha[i] = new
                w[f] += d * v
                bias += d
                most = max(most, abs(d))
        if most < 1e-3:
            break
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 4000) -> Model:
    """docs and labels share an id; ids without a 0/1 label teach nothing. sample_rows bounds the rows that the hinge loss
    is fitted on."""
    src = labelled(docs, labels, id_col, text_col, label_col).select("text", "y")
    counted = pa.schema([("f", pa.int32()), ("n0", pa.int64()), ("n1", pa.int64())])

    def count(batches):
        n = np.zeros((2, BINS), np.int64)
        rows = [0, 0]
        for b in batches:
            for t, y in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), strict=True):
                n[y][features(t)] += 1
                rows[y] += 1
        some = np.flatnonzero(n.any(axis=0))
        yield tk.batch(counted, f=[-1], n0=[rows[0]], n1=[rows[1]])
        yield tk.batch(counted, f=some, n0=n[0][some], n1=n[1][some])

    sums = arrow_pass(src, count, "f int, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    f, n0, n1 = (np.asarray(sums.column(k)) for k in ("f", "n0", "n1"))
    total = np.array([n0[f < 0].sum(), n1[f < 0].sum()], float)
    prior = float(total[1] / total.sum()) if total.sum() else 0.5
    if not total.all():
        return Model(np.zeros(0, np.float32), 0.0, 0.0, 0.0, prior)
    n = np.zeros((2, BINS))
    n[0][f[f >= 0]], n[1][f[f >= 0]] = n0[f >= 0], n1[f >= 0]
    ratio = np.log((n[1] + 1) / (total[1] + 2)) - np.log((n[0] + 1) / (total[0] + 2))
    rowed = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("f", pa.binary())])

    def read(batches):
        for b in batches:
            yield tk.batch(rowed, id=b.column(0), y=b.column(2), f=[features(t).astype("<i4").tobytes() for t in b.column(1).cast(pa.binary()).to_pylist()])

    sample = label_sample(docs, labels, id_col, text_col, label_col, sample_rows)
    picked = arrow_pass(sample, read, "id long, y int, f binary").orderBy(F.xxhash64("id"), "id", "y", "f").limit(sample_rows).toArrow()
    rows = [np.frombuffer(x, "<i4") for x in picked.column("f").to_pylist()]
    y = np.asarray(picked.column("y")).astype(float) * 2 - 1
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(0, np.float32), 0.0, 0.0, 0.0, prior)
    w, bias = dual_coordinate_descent(rows, ratio, y)
    weight = (w * ratio).astype(np.float32)
    margin = np.array([float(weight[f].sum(dtype=np.float64)) / np.sqrt(len(f)) + bias for f in rows])
    slope, offset = _logistic(margin, (y > 0).astype(float))
    return Model(weight, bias, slope, offset, prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS numbers

    def run(batches):
        m = shared.value
        for b in batches:
            yield tk.batch(schema, doc_id=b.column(0), score=[m.score(t) for t in b.column(1).cast(pa.binary()).to_pylist()])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_pass(src, run, "doc_id long, score double")
