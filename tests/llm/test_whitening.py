"""Whitening against numpy on whole tables."""

import math
from collections import defaultdict

import numpy as np
import pytest

from vacantia.llm import queries
from vacantia.llm import whitening as w

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, x string, v string, i int"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 1, "a", "b", None, 3) for k, v in rows], SCHEMA)


def brute(rows, components=32):
    """``n``, deviations, eigenvalues, covariance of the usable rows."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    dev = [sum((n * c - t) ** 2 for c, t in zip(r, s, strict=True)) for r in x]
    cov = np.array([[(n * sum(r[i] * r[j] for r in x) - s[i] * s[j]) / n**2 for j in range(d)] for i in range(d)])
    return n, dev, np.sort(np.linalg.eigvalsh(cov))[::-1][:components], cov, x, s


def check(got, rows, components=32):
    n, dev, e, cov, x, s = brute(rows, components)
    by = defaultdict(list)
    for r in got:
        by[r.component].append(r)
    assert set(by) == set(range(1, min(components, len(s)) + 1)) and all(len(v) == n for v in by.values())
    assert {r.n for r in got} == {n}
    assert sorted(int(r.deviation) for r in by[1]) == sorted(dev)
    centred = (np.array(x, float) - np.array([t / n for t in s]))
    for c, lam in enumerate(e, 1):
        assert abs(by[c][0].explained - lam / np.trace(cov)) <= 1e-9
        if lam > 1e-9 * e[0]:
            z = sorted(r.whitened for r in by[c])
            vec = np.linalg.eigh(cov)[1][:, ::-1][:, c - 1]
            want = np.sort(centred @ vec / math.sqrt(lam))
            assert np.allclose(z, want, atol=1e-6) or np.allclose(z, -want[::-1], atol=1e-6)
    assert len({r.identity_error for r in got}) == 1
    return got[0].identity_error


def test_cross_products_are_exact():
    rng = np.random.default_rng(3)
    y = np.stack([rng.integers(0, 2**b, 300) if b else np.zeros(300, np.int64) for b in (1, 0, 7, 50, 3)], 1)
    sums, products = w.cross_products(y, [1, 0, 7, 50, 3])
    big = y.astype(object)
    assert list(sums) == list(big.sum(0))
    assert all(products[i, j] == (big[:, i] * big[:, j]).sum() for i in range(5) for j in range(i, 5))


def test_equals_numpy(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(6, 6))
    rows = [(k, [float(c) for c in rng.normal(size=6) @ mix]) for k in range(400)]
    rows += [(7, rows[7][1])] * 30 + [(None, rows[9][1])]
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (902, [math.nan] * 6), (903, [math.inf] + [0.0] * 5), (904, [1.0, 2.0]), (905, []), (906, [1e30] * 6)]
    got = w.whiten(frame(spark, rows + bad).repartition(3)).collect()
    assert check(got, rows) < 1e-9
    assert sum(r.id is None for r in got) == 6 and sum(r.id == 7 for r in got) == 6 * 31
    few = w.whiten(frame(spark, rows), components=2).collect()
    assert check(few, rows, 2) < 1e-9


def test_wide_values_and_flat_directions(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(rng.integers(-10**10, 10**10)), float(k % 3), 5.0]) for k in range(200)]
    got = w.whiten(frame(spark, rows)).collect()
    n, dev, *_ = brute(rows)
    assert sorted(int(r.deviation) for r in got if r.component == 1) == sorted(dev)
    assert all((r.whitened is None) == (r.component > 1) for r in got)  # the second has 1e-20 of the first's variance


def test_one_vector_and_none(spark):
    got = w.whiten(frame(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r.id, r.component, int(r.deviation), r.whitened, r.identity_error) for r in got] == [(1, 1, 0, None, None), (1, 2, 0, None, None)]
    none = w.whiten(frame(spark, [(1, None), (2, [])]))
    assert none.collect() == [] and none.columns == w.whiten(frame(spark, [])).columns


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_registered_query(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = queries.op13_whitening(spark, d)
    assert dict(got.dtypes) | {} == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert check(got.collect(), rows) <= 1e-4
