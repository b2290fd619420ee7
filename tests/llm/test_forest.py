import numpy as np

from quire.llm import forest
from tests.llm.test_near import VECS, usable, vector_rows


def search(spark, rows, **k):
    return forest.search(spark.createDataFrame(rows, VECS), **k).collect()


def exact(rows, every, k):
    good = [(i, np.array(v, np.float64)) for i, v, *_ in rows if usable(i, v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            d = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q)
            out[q] = d[:k]
    return out


def test_small_table_is_exact(spark):
    rows = vector_rows()
    got = {}
    for r in search(spark, rows, every=10):
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    want = exact(rows, 10, 10)
    assert got.keys() == want.keys()
    found = total = 0
    for q, hits in got.items():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, len(hits) + 1))
        assert sorted(h[1:] for h in hits) == [h[1:] for h in hits]
        true = {i for _, i in want[q]}
        found += len(true & {h[2] for h in hits})
        total += len(true)
    assert found / total >= 0.9


def test_recall(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((9000, 24))
    x[:3000] = x[0] + 0.05 * rng.standard_normal((3000, 24))  # a dense third
    rows = [(i, v.tolist(), 0, "", "") for i, v in enumerate(x)]
    want = exact(rows, 100, 10)
    hits = search(spark, rows)
    found = sum((r.vec_id in {i for _, i in want[r.query_id]}) for r in hits)
    assert found / sum(len(v) for v in want.values()) >= 0.9


def test_ties_and_few(spark):
    rows = [(i, [1.0, 0.0], 0, "", "") for i in range(300)] + [(300, [0.0, 1.0], 0, "", "")]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in search(spark, rows)]
    assert [g[2] for g in sorted(got) if g[0] == 100] == list(range(10))
    assert [g[2] for g in sorted(got) if g[0] == 0] == list(range(1, 11))
    assert sorted(search(spark, rows[:3]))[-1]["rank"] == 2
    assert search(spark, []) == []
    assert search(spark, rows[1:5]) == []
    odd = [(0, [1.0, 2.0], 0, "", ""), (1, [1.0], 0, "", ""), (2, [1.0, 3.0], 0, "", ""), (100, [1.0, 2.0, 3.0], 0, "", "")]
    assert [(r.query_id, r.vec_id) for r in search(spark, odd)] == [(0, 2)]


def test_repeated_rows_take_one_place(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 8))
    rows = [(i, v.tolist(), 0, "", "") for i, v in enumerate(x)]
    rows += [(7, (x[0] + 1e-3).tolist(), 0, "", "")] * 20 + [(0, (x[0] + 1e-4 * i).tolist(), 0, "", "") for i in range(1, 15)]
    got = [r for r in search(spark, rows, every=400)]
    assert len([r for r in got if r["rank"] == 10]) == 1 and sum(r.vec_id == 7 and r.score < 0.01 for r in got) == 1 and all(r.vec_id for r in got)


def test_dense_groups_are_grids(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 64)
    monkeypatch.setattr(forest, "QUERIES", 8)
    rng = np.random.default_rng(6)
    x = np.repeat(rng.standard_normal((40, 16)), 50, axis=0) + 0.01 * rng.standard_normal((2000, 16))
    rows = [(i, v.tolist(), 0, "", "") for i, v in enumerate(x)]
    want = exact(rows, 10, 10)
    hits = search(spark, rows, every=10)
    assert len(hits) == 2000 and sum((r.vec_id in {i for _, i in want[r.query_id]}) for r in hits) / 2000 >= 0.9
