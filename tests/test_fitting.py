"""The combiner fitted in Spark against a plain fit in the driver; composition, pairing and ids as they were mended."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import keys
from corpusloom.operators import differences, fitting, links


def plain_fit(x, y, ridge):
    """Newton's steps over the whole matrix, of scaled features."""
    m, s = x.mean(0), x.std(0)
    s[s == 0] = 1
    z = np.hstack([np.ones((len(x), 1)), (x - m) / s])
    p, w = np.r_[0.0, np.full(x.shape[1], ridge)], np.zeros(z.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-z @ w))
        w = w + np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + np.diag(p + 1e-12), z.T @ (y - q) - p * w)
    return m, s, w


@pytest.fixture(scope="module")
def rows():
    dice = np.random.default_rng(5)
    x = dice.normal(size=(600, 4)) * [1, 10, 0.1, 3] + [0, 5, 0, -2]
    y = (dice.random(600) < 1 / (1 + np.exp(-(x @ [1.5, -0.2, 4, 0] + 0.5)))).astype(int)
    return x, y, dice.integers(0, 3, 600)


def test_coefficients_equal_a_plain_fit(spark, rows):
    x, y, fold = rows
    table = spark.createDataFrame([(a.tolist(), int(b), int(f)) for a, b, f in zip(x, y, fold, strict=True)] + [(None, 1, 0), ([1.0, None, 0.0, 0.0], 1, 1), ([1.0] * 4, None, 1)], "x array<double>, y int, fold int").repartition(3)
    got = fitting.fit(table, 3, ridge=0.5)
    m, s = x.mean(0), x.std(0)
    for k in range(3):
        own = fold != k
        z = np.hstack([np.ones((own.sum(), 1)), (x[own] - m) / s])
        w = np.r_[got[k, 0] + got[k, 1:] @ m, got[k, 1:] * s]
        slope = z.T @ (y[own] - fitting.probability(z, w)) - np.r_[0.0, np.full(4, 0.5)] * w
        assert np.abs(slope).max() < 1e-6  # where the penalised likelihood is highest
    _, _, w = plain_fit(x, y, 0.5)
    whole = fitting.fit(table, 4, ridge=0.5)[3]  # a fold without rows: its model has seen all
    assert np.abs(np.r_[whole[0] + whole[1:] @ m, whole[1:] * s] - w).max() < 1e-6
    scored = fitting.held_out(table.filter("size(x) = 4 AND y IS NOT NULL AND NOT exists(x, v -> v IS NULL)"), got).collect()
    for r in scored[:50]:
        assert abs(r.probability - 1 / (1 + np.exp(-(got[r.fold, 0] + np.dot(got[r.fold, 1:], r.x))))) < 1e-9


def test_separable_and_empty_data(spark):
    table = spark.createDataFrame([([float(k)], int(k > 5), k % 2) for k in range(12)], "x array<double>, y int, fold int")
    got = fitting.fit(table, 2)
    assert np.isfinite(got).all() and (got[:, 1] > 0).all()
    assert fitting.fit(table.limit(0), 2).tolist() == [[0.0], [0.0]]
    errors = {r.fold: r for r in fitting.error_by_fold(fitting.held_out(table, got)).collect()}
    assert all(r.edges == 6 and 0 <= r.aer < 0.5 for r in errors.values())


def test_composition_takes_the_best_of_each_hop(spark):
    pick = random.Random(3)
    conf = lambda: pick.choice([None, 0.2, 0.5, 0.9])
    a, b = ([(pick.randrange(5), pick.randrange(4), conf()) for _ in range(60)] for _ in range(2))
    want = {}
    for x, m, c in a:
        for n, z, d in b:
            if m == n:
                want[x, z] = max(want.get((x, z), 0), (1 if c is None else c) * (1 if d is None else d))
    got = links.compose(spark.createDataFrame(a, "a int, b int, c1 double"), spark.createDataFrame(b, "b int, c int, c2 double"))
    assert {(r.a, r.c): round(r.confidence, 9) for r in got.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_many_places_pair_quickly():
    pick = random.Random(2)
    places = pick.sample(range(200_000), 40_000)
    got = differences.nearest_pairs(sorted(places[:20_000]), sorted(places[20_000:]))
    assert len(got) == 20_000 and len({i for i, _ in got}) == len({j for _, j in got}) == 20_000


def test_ids_that_collide_are_made_anew(spark, monkeypatch):
    monkeypatch.setattr(keys, "id52", lambda key: F.when(key.isin("a", "b", "b|1"), 7).when(key == "z", 0).otherwise(F.length(key) + 10).cast("long"))
    got = {r.k: r.id for r in keys.with_ids(spark.createDataFrame([(x,) for x in ("a", "b", "c", "z")], "k string"), "k").collect()}
    assert got["a"] == 7 and got["c"] == 11 and len(set(got.values())) == 4 and 0 not in got.values()


def test_combiner_by_fold_over_a_whole_table(spark):
    """The registered query's 49 features: each fold's model stands where its likelihood, which is concave, is highest; its errors follow."""
    from corpusloom.plans import linking
    from corpusloom.session import kept, tables

    t = tables(spark, "/root/testdata/sf0.001")
    rows = kept(linking.combiner_rows(t))
    found = rows.collect()
    x, y, fold = np.array([r.x for r in found]), np.array([r.y for r in found]), np.array([r.fold for r in found])
    assert x.shape[1] == 49
    models = fitting.fit(rows, 5)
    m, s = x.mean(0), x.std(0)
    s[s == 0] = 1
    got = {r.fold: r for r in linking.combiner_by_fold(t).collect()}
    for k in sorted(set(fold.tolist())):
        z, w = np.hstack([np.ones(((fold != k).sum(), 1)), (x[fold != k] - m) / s]), np.r_[models[k, 0] + models[k, 1:] @ m, models[k, 1:] * s]
        slope = z.T @ (y[fold != k] - fitting.probability(z, w)) - np.r_[0.0, np.full(49, 1e-3)] * w
        assert np.abs(slope).max() < 1e-4
        own = models[k, 0] + x[fold == k] @ models[k, 1:] >= 0
        aer = 1 - 2 * (own & (y[fold == k] == 1)).sum() / max(1, own.sum() + y[fold == k].sum())
        assert got[k].edges == (fold == k).sum() and got[k].gold == y[fold == k].sum() and abs(got[k].aer - aer) < 1e-3
