import hashlib
import random

import numpy as np

from quire.llm import suffixes
from tests.llm.conftest import DOCS, prose


def brute(rows, size=400):
    seen = {}
    raw = [(t or "").encode() for _, t in rows]
    for b in raw:
        for i in range(len(b) - size + 1):
            w = hash(b[i : i + size])
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (d, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - size + 1):
            if seen[hash(b[i : i + size])] > 1:
                gone[i : i + size] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_odd_documents(spark, odd, odd_rows):
    got = sorted((tuple(r) for r in suffixes.removals(odd).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    assert got == brute([(r[0], r[1]) for r in odd_rows])


def test_shared_passages(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 1 << 14)  # many blocks, so strings meet across them
    rng = random.Random(8)
    passages = [prose(rng, 90)[:k] for k in (399, 400, 401, 420, 500)]
    rows = []
    for i in range(80):
        parts = [prose(rng, rng.randint(1, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            parts += [p[rng.choice([0, 0, 5]) :], prose(rng, rng.randint(0, 30))]
        rows.append((i, "|".join(parts)))
    rows += [(100 + i, passages[4] + str(i)) for i in range(60)]
    df = spark.createDataFrame([(i, t) + (None,) * 8 for i, t in rows], DOCS)
    got = sorted((tuple(r) for r in suffixes.removals(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    assert got == brute(rows)


def test_repeated_rows_tell_other_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 1 << 9)
    rng = random.Random(12)
    rows = []
    for i in range(20):
        shared = prose(rng, 110)[:500]
        copy = prose(rng, 30) + shared + prose(rng, 30)
        rows += [(i if i % 2 else None, copy)] * 8 + [(100 + i, prose(rng, 40) + shared + prose(rng, 20))]
    df = spark.createDataFrame([(i, t) + (None,) * 8 for i, t in rows], DOCS)
    got = sorted((tuple(r) for r in suffixes.removals(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
    assert got == brute(rows)


def test_pieces_and_sizes(spark, monkeypatch):
    """Long stretches are cut into pieces; strings across a cut, and periodic texts, still meet those of other blocks."""
    monkeypatch.setattr(suffixes, "PIECE", 100)
    monkeypatch.setattr(suffixes, "BLOCK", 1 << 10)
    rng = random.Random(13)
    rows = []
    for i in range(12):
        shared = prose(rng, rng.choice([60, 150, 400]))
        rows += [(10 * i + k, prose(rng, 20) + shared[rng.randint(0, 20) :] + prose(rng, 20)) for k in range(rng.randint(2, 5))]
    rows += [(500, "ab" * 900 + "c"), (501, "x" + "ab" * 700), (502, "den " * 60 + "q"), (503, prose(rng, 10) + "den " * 150)]
    df = spark.createDataFrame([(i, t) + (None,) * 8 for i, t in rows], DOCS)
    for size in (200, 400):
        got = sorted((tuple(r) for r in suffixes.removals(df, size=size).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)
        assert got == brute(rows, size)


def test_drop_repeats(spark, odd, odd_rows, nothing):
    out = suffixes.drop_repeats(odd)
    assert out.columns == odd.columns and out.count() == len(odd_rows)
    got = {r.doc_id: r for r in out.where("doc_id not in (17, 20)").collect()}
    assert got[1].text == "" and got[1].n_chars == 0 and got[7].text is None and got[5].text == {r[0]: r[1] for r in odd_rows}[5]
    assert suffixes.drop_repeats(nothing).count() == 0 and suffixes.removals(nothing).count() == 0


def test_interval_expansion():
    rng = np.random.default_rng(0)
    for trial in range(10):
        t = rng.integers(1, 4, 2000).astype(np.int16)
        for _ in range(6):
            a, b = rng.integers(0, 1800, 2)
            t[b : b + 100] = t[a : a + 100]
        if trial % 2:
            t[500:900] = np.tile([1, 2, 3], 400)[:400]
        t[rng.integers(0, 2000, 20)] = 0
        t[-1] = 0
        cls = suffixes.repeated_runs(t, 12)
        groups = {}
        for i in range(1980):
            if (t[i : i + 12] > 0).all():
                groups.setdefault(t[i : i + 12].tobytes(), set()).add(int(cls[i]))
        assert all(len(g) == 1 for g in groups.values())
        assert len(set.union(*groups.values())) == len(groups)
