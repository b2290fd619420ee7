"""Language identification with hyperdimensional profiles.

Every letter has a random vector of DIMS entries +1 and -1, made from its code point, whatever its script; what is no letter
is one blank, with a vector of its own. A trigram's vector binds its letters' vectors, the earlier ones permuted (rotated)
by their distance from the end. A text's vector is the bundle (sum) of the vectors of its trigrams, one around each letter;
a language's prototype is the bundle of its training texts' vectors. A text takes the language whose prototype has the
largest cosine; ties go to the smaller name.

Vectors are kept as bits, in which binding is an exclusive or; the bundles of many texts are one product of their trigram
counts with the trigrams' vectors.

Defined results: null texts and texts without a letter give `und` with score 0, as do all texts if nothing was learned;
ids may be null or repeat, each row gives a row; repeated rows all teach; extra columns are not read. A row with null text
or null label teaches nothing.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import textkit as tk
from quire.llm.common import arrow_pass

DIMS = 4096
#: Characters of the texts that are bundled at once, each for itself or by label, and trigrams of one product.
_CHARS = 1 << 18
_LABELLED_CHARS = 1 << 22
_PRODUCT = 512
#: Entries of the pieces in which tasks send their sums.
_PIECE = 512
_U = np.uint64


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_bits(code_points: np.ndarray) -> np.ndarray:
    """A row of DIMS bits for each code point, packed."""
    word = np.arange(DIMS // 64, dtype=_U) + _U(1 << 40)
    return tk.mix(tk.mix(code_points.astype(_U))[:, None] + tk.mix(word)[None, :]).view(np.uint8)


def trigram_bits(key: np.ndarray) -> np.ndarray:
    """A row of DIMS bits for each trigram (three code points of 21 bits each), packed."""
    out = np.zeros((len(key), DIMS // 8), np.uint8)
    for turn in (0, 1, 2):  # the last letter is not rotated
        cp, at = np.unique((key >> (21 * turn)) & 0x1FFFFF, return_inverse=True)
        bits = letter_bits(cp)
        if turn:
            bits = np.packbits(np.roll(np.unpackbits(bits, axis=1), turn, axis=1), axis=1)
        out ^= bits[at]
    return out


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of consecutive texts as numbers, one for each letter, with the characters beside it; and the text of each."""
    low = [(t or "").lower() for t in texts]
    cp = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    cp[~_letters()[cp]] = 0
    at = np.flatnonzero(cp)
    begin = np.cumsum([1] + [len(t) + 1 for t in low])
    return cp[at - 1] << 42 | cp[at] << 21 | cp[at + 1], np.searchsorted(begin, at, "right") - 1


def bundle(key: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """The sums of the trigrams' vectors by group."""
    out = np.zeros((groups, DIMS), np.float32)
    order = np.argsort(key)
    key, group = key[order], group[order]
    new = np.diff(key, prepend=-1) != 0
    known, at = key[new], np.cumsum(new) - 1
    for i in range(0, len(known), _PRODUCT):
        some = known[i : i + _PRODUCT]
        a, b = np.searchsorted(at, (i, i + len(some)))
        count = np.bincount(group[a:b] * len(some) + at[a:b] - i, minlength=groups * len(some)).reshape(groups, -1).astype(np.float32)
        sign = np.unpackbits(trigram_bits(some), axis=1).astype(np.float32)
        out += count.sum(axis=1, keepdims=True) - 2 * (count @ sign)
    return out


def _some(texts: list[str | None], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about so many characters; a longer text is a range of its own."""
    a = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > a and size + n > chars:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)


def vectors(texts: list[str | None]) -> np.ndarray:
    """The unit vector of each text, zero without a letter."""
    v = bundle(*trigrams(texts), len(texts))
    return v / np.maximum(np.sqrt((v.astype(np.float64) ** 2).sum(axis=1, keepdims=True)), 1e-12).astype(np.float32)


def learn(rows: DataFrame, text_col: str = "text", label_col: str = "lang") -> dict[str, np.ndarray]:
    """Unit prototypes by label, from every row. Tasks bundle their rows by label and send one vector for each; these are
    added up as they arrive, in pieces, and the driver gets one vector for each label."""
    sent = pa.schema([("lang", pa.string()), ("piece", pa.int32()), ("v", pa.binary())])

    def pieces(sums: dict[tuple, np.ndarray]):
        keys = sorted(sums)
        yield tk.batch(sent, lang=[k[0] for k in keys], piece=[k[1] for k in keys], v=[sums[k].tobytes() for k in keys])

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            text, lang = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in _some(text, _LABELLED_CHARS):
                names, of = np.unique(np.array(lang[i:j], object).astype(str), return_inverse=True)
                key, row = trigrams(text[i:j])
                v = bundle(key, of[row], len(names)).astype(np.float64)
                for y, x in zip(names.tolist(), v, strict=True):
                    for p in range(DIMS // _PIECE):
                        have = sums.setdefault((y, p), np.zeros(_PIECE))
                        have += x[p * _PIECE : (p + 1) * _PIECE]
        yield from pieces(sums)

    def add(batches):
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            for y, p, v in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                have = sums.setdefault((y, p), np.zeros(_PIECE))
                have += np.frombuffer(v)
        yield from pieces(sums)

    src = rows.where(F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("lang"))
    kind = "lang string, piece int, v binary"
    got = arrow_pass(arrow_pass(src, run, kind).repartition("lang", "piece"), add, kind).collect()
    protos: dict[str, np.ndarray] = {}
    for r in got:
        protos.setdefault(r.lang, np.zeros(DIMS))[r.piece * _PIECE : (r.piece + 1) * _PIECE] += np.frombuffer(bytes(r.v))
    return {y: (v / np.sqrt(v @ v)).astype(np.float32) for y, v in sorted(protos.items()) if v.any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row; score is the cosine, at least 0."""
    names = sorted(prototypes)
    matrix = np.stack([prototypes[y] for y in names]) if names else np.zeros((0, DIMS), np.float32)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        for b in batches:
            text = b.column(1).to_pylist()
            pred, score = ["und"] * len(text), np.zeros(len(text))
            for i, j in _some(text, _CHARS) if names else ():
                v = vectors(text[i:j])
                cos = v @ matrix.T
                best = cos.argmax(axis=1)
                for k in np.flatnonzero(v.any(axis=1)).tolist():
                    pred[i + k], score[i + k] = names[best[k]], min(1.0, max(0.0, float(cos[k, best[k]])))
            yield tk.batch(schema, doc_id=b.column(0), lang_pred=pred, score=score)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_pass(src, run, "doc_id long, lang_pred string, score double")
